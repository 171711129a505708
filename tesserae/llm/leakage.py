"""Passages of held-out evaluation items inside corpus documents.

A passage is a stretch of at least ``min_words`` words of an item which the document has in
order, with at most one error in ``per_error`` of its words. Between two words of a passage that
are neighbours in the item and the document there is no error; any other gap costs as many
errors as item words are lost in it, or one for each ``per_mask`` words that the document has in
their place (a mask such as "[name withheld]" has more words than it hides), whichever is more.
First and last word of a passage are unaltered.

One Aho-Corasick automaton over the words of all items finds seeds: every run of ``seed``
words of an item. With e errors the words left, at least seven times e, stand in at most e + 1
unbroken runs, so one of them has 6 words: no passage escapes the scan. Seeds are drawn out to
unbroken runs. If there is any passage, there is one of at most ``2 * min_words + 7`` words (a
longer one can be cut in two so that one part is a passage as well), which bounds what
has to be looked at around a run: first by a filter over all runs at once (are enough of the
item's next words among the document's nearby ones?), then by exact dynamic programming.

Normalising: layout does not count. Page headers and paragraph numbers are dropped, words divided
at line ends are joined, case and punctuation are folded, and so are the digits that
scans confuse with letters.

Defined results: null, blank and short texts leak nothing; documents that repeat an id report
as one; an item with fewer than ``min_words`` words, or without a text, can't be found; of
repeated item ids each text counts under the id. Texts of any length are scanned whole.
"""

from __future__ import annotations

import bisect
import re
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

try:
    import ahocorasick
except ImportError:  # the scan needs it, the package doesn't
    ahocorasick = None

#: Raw tokens in the memo of one worker; it is emptied beyond that.
MEMO_SIZE = 400_000
#: Bytes of item text that one automaton holds. More items are scanned in parts, each by an automaton of its own.
PART_BYTES = 4 << 20
#: Bytes of one part beyond which it is an error: no item is that long.
MAX_PART_BYTES = 2 * PART_BYTES
#: Errors up to which the longest passage is sought, once a pair is found. Only the reported length depends on it.
MAX_ERRORS = 24
#: Words of a text whose seeds are looked at together, and runs that are filtered together.
BLOCK, RUNS = 16_384, 2_048
#: Words of an item on either side of a run up to which a passage is followed for its length.
MARGIN = 2_000

#: What a page header looks like: patterns of a whole line, tried on lines of at most HEADER_LENGTH letters.
HEADERS = (r"Page \d+ of \d+ .*", r".* [vV] .*(?: - \[\d{4}\] \w+ \d+ - \d+| {2,}\d+/\d+)")
HEADER_LENGTH = 200

_PUNCTUATION = re.compile(r"[\W_]+")
_CONFUSED = str.maketrans("10", "lo")
_DIVIDED = re.compile(r"(?<=\w)-[ \t]*\n\s*(?=\w)")
_NUMBER = re.compile(r"^[ \t]*(?:\[\d{1,3}\]|\(\d{1,3}\)|\d{1,3}\.|§ ?\d{1,3})(?=\s|$)", re.M)


def normal(token: str) -> str:
    """A blank-delimited token as it is compared: lower case, letters and digits only."""
    return _PUNCTUATION.sub("", token.lower()).translate(_CONFUSED)


def _blank(match: re.Match) -> str:
    return " " * (match.end() - match.start())


def header_lines(patterns: Sequence[str] = HEADERS) -> re.Pattern:
    """One pattern for all page headers."""
    return re.compile("|".join(f"(?:{p})" for p in patterns))


_HEADER = header_lines()


def headless(text: str, header: re.Pattern = _HEADER) -> str:
    """``text`` with page headers blanked out; offsets stay.

    Only short lines are tried as headers, so that the time is in proportion to the text's length.
    """
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if len(line) <= HEADER_LENGTH and header.fullmatch(line):
            lines[i] = " " * len(line)
    return "\n".join(lines)


def running(text: str, header: re.Pattern = _HEADER) -> str:
    """``text`` with page headers and paragraph numbers blanked out; offsets stay."""
    return _NUMBER.sub(_blank, headless(text, header))


def _joined(text: str, header: re.Pattern) -> str:
    text = running(text, header)
    return _DIVIDED.sub("", text) if "-" in text and "\n" in text else text


def tokens(text: str, header: re.Pattern = _HEADER) -> list[str]:
    """The raw tokens of a text, divided words joined."""
    return _joined(text, header).split()


def span(text: str, first_word: int, last_word: int, header: re.Pattern = _HEADER) -> tuple[int, int]:
    """The characters (start, end) of the original text from its word ``first_word`` to its word ``last_word``, both counted as ``tokens`` does."""
    clean = running(text, header)  # of the same length as the text
    # Where something was taken out to join a word, and how much up to there.
    at, gone, total = [], [], 0
    for m in _DIVIDED.finditer(clean):
        at.append(m.start() - total)
        total += m.end() - m.start()
        gone.append(total)

    def original(i: int) -> int:
        k = bisect.bisect_right(at, i)
        return i + (gone[k - 1] if k else 0)

    number, start, end = -1, 0, 0
    for m in re.finditer(r"\S+", _joined(text, header)):
        if normal(m[0]):
            number += 1
            if number == first_word:
                start = original(m.start())
            if number == last_word:
                end = original(m.end() - 1) + 1
                break
    return start, end


def _letter(number: int) -> str:
    """A word number as one letter; surrogates are left out."""
    return chr(number if number < 0xD800 else number + 0x800)


#: The letter of words that no item has. Those of items begin after it.
UNKNOWN = 1


class Memo(dict):
    """Raw token -> the letter of its word; nothing for tokens without a word."""

    def __init__(self, vocabulary: dict[str, str]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, token: str) -> str:
        if len(self) > MEMO_SIZE:
            self.clear()
        word = normal(token)
        found = self[token] = self.vocabulary.get(word, chr(UNKNOWN)) if word else ""
        return found


def _codes(letters: str) -> np.ndarray:
    return np.frombuffer(letters.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)


def seed_length(min_words: int, per_error: int) -> int:
    """The length that the longest unbroken run of every passage has at least."""
    most = 2 * min_words * per_error // (per_error - 1) // per_error
    return min(-(-(max(min_words, per_error * e) - e) // (e + 1)) for e in range(most + 1))


class Scanner:
    """The automaton over all items, and the check of what it finds."""

    def __init__(self, items: Iterable[tuple[object, str | None]], min_words: int = 25, per_error: int = 8, per_mask: int = 4, header: re.Pattern = _HEADER):
        self.min_words, self.per_error, self.per_mask, self.header = min_words, per_error, per_mask, header
        self.seed = seed_length(min_words, per_error)
        #: The longest passage that need be looked at to tell whether there is one, and its errors.
        self.short = 2 * min_words * per_error // (per_error - 1)
        self.short_errors = self.short // per_error
        vocabulary: dict[str, str] = {}
        self.names: list[object] = []
        texts: list[str] = []
        for item, text in items:
            words = [w for w in map(normal, tokens(text or "", header)) if w]
            if len(words) >= min_words:
                self.names.append(item)
                texts.append("".join(vocabulary.setdefault(w, _letter(len(vocabulary) + UNKNOWN + 1)) for w in words))
        self.memo = Memo(vocabulary)
        #: All items behind one another, and where each begins; a place in ``words`` stands for item and position.
        self.words = _codes("".join(texts))
        self.begins = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        seeds: dict[str, list[int]] = defaultdict(list)
        for begin, text in zip(self.begins.tolist(), texts):
            for p in range(len(text) - self.seed + 1):
                seeds[text[p : p + self.seed]].append(begin + p)
        self.places = np.array([g for found in seeds.values() for g in found], dtype=np.int64)
        self.counts = np.array([len(found) for found in seeds.values()], dtype=np.int64)
        self.firsts = np.concatenate(([0], np.cumsum(self.counts)))
        #: For each letter its number among the words of the text at hand.
        self.rank = np.zeros(ord(_letter(len(vocabulary) + UNKNOWN)) + 1, dtype=np.int32)
        self.automaton = None
        if seeds:
            if ahocorasick is None:
                raise RuntimeError("the leakage scan needs pyahocorasick")
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for number, letters in enumerate(seeds):
                self.automaton.add_word(letters, number)
            self.automaton.make_automaton()

    def letters(self, text: str) -> str:
        """A text as one letter a word."""
        return "".join(map(self.memo.__getitem__, tokens(text, self.header)))

    def _runs(self, letters: str, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The unbroken runs (document position, place in the items, length) whose seeds begin in [start, stop)."""
        hits = list(self.automaton.iter(letters, start, min(len(letters), stop + self.seed - 1)))
        if not hits:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        found = np.array(hits, dtype=np.int64)
        number = found[:, 1]
        n = self.counts[number]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        k = np.repeat(found[:, 0] - self.seed + 1, n)
        g = self.places[np.repeat(self.firsts[number], n) + within]
        order = np.lexsort((k, k - g))
        k, g = k[order], g[order]
        # Seeds never cross items, so neighbours on a diagonal belong to one item.
        new = np.flatnonzero(np.concatenate(([True], (np.diff(k) != 1) | (np.diff(g) != 1))))
        return k[new], g[new], np.diff(np.append(new, len(k))) + self.seed - 1

    def _promising(self, codes: np.ndarray, k: np.ndarray, g: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The runs about which a short passage may be: some stretch of the item has most of its words near by."""
        longest, margin = 2 * self.seed, self.short - self.seed
        out = n > longest
        plain = np.flatnonzero(~out)
        if not len(plain):
            return np.flatnonzero(out)
        item = np.searchsorted(self.begins, g, side="right") - 1
        offset = np.arange(-margin, longest + margin, dtype=np.int32)
        # How far the document may be behind and ahead of a run's diagonal, each place being told as part of the next block of that width.
        most = self.short_errors * self.per_mask
        block = most + self.short_errors + 1
        low = offset - np.where(offset < 0, most, self.short_errors)
        start = max(0, int(k[plain].min()) - margin - most)
        near_by = codes[start : int(k[plain].max()) + longest + margin + most]
        held = np.unique(near_by[near_by > UNKNOWN])
        self.rank[held] = np.arange(1, len(held) + 1)
        there = np.zeros((len(near_by) // block + 3, len(held) + 1), dtype=bool)
        there[1 + np.arange(len(near_by)) // block, self.rank[near_by]] = True
        there[:, 0] = False
        there = (there[:-1] | there[1:]).ravel()
        for part in (plain[i : i + RUNS] for i in range(0, len(plain), RUNS)):
            word, inside = self._around(g[part], item[part], offset)
            row = np.clip(1 + (k[part, None] + (low - start)) // block, 0, len(near_by) // block + 1)
            out[part] = self._stretch(there.take(row * (len(held) + 1) + self.rank.take(word)), inside)
        self.rank[held] = 0
        # Few are left; of these each place is told exactly.
        left = plain[out[plain]]
        keys = np.sort(near_by * len(near_by) + np.arange(len(near_by))) if len(left) else None
        for part in (left[i : i + RUNS] for i in range(0, len(left), RUNS)):
            word, inside = self._around(g[part], item[part], offset)
            at = k[part, None] + (low - start)
            first = word * len(near_by) + np.clip(at, 0, len(near_by) - 1)
            last = word * len(near_by) + np.clip(at + block - 1, 0, len(near_by) - 1)
            out[part] = self._stretch(np.searchsorted(keys, first) < np.searchsorted(keys, last, side="right"), inside)
        return np.flatnonzero(out)

    def _around(self, g: np.ndarray, item: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The item words at these offsets from each place, and whether they are the same item's."""
        place = g[:, None] + offset
        inside = (place >= self.begins[item, None]) & (place < self.begins[item + 1, None])
        return self.words.take(place, mode="clip"), inside

    def _stretch(self, near: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """For each row whether some stretch of ``min_words`` places or more is within the error rate."""
        score = np.where(near, np.int32(1), np.int32(1 - self.per_error))
        score[~inside] = -self.short * self.per_error
        score = np.cumsum(score, axis=1, dtype=np.int32)
        # Before the first place the sum is zero; a stretch begins behind the lowest sum so far.
        lowest = np.minimum(np.minimum.accumulate(score[:, : -self.min_words], axis=1), 0)
        return (score[:, self.min_words :] >= lowest).any(axis=1) | (score[:, self.min_words - 1] >= 0)

    def passage(self, codes: np.ndarray, k: int, g: int, n: int, errors: int, margin: int) -> tuple[int, int, int] | None:
        """(words of the item, first and last word of the document) of the longest passage of at most ``errors`` errors
        near the diagonal of a run, up to ``margin`` item words around it; None if there is none.

        A cell (row, column) stands for an item word and a document word, columns being diagonals.
        ``held`` has for each cell the most item words of a passage, or of a beginning of one with a gap, that goes up to there with so many
        errors; times SHIFT, plus the column in which it began.
        """
        item = int(np.searchsorted(self.begins, g, side="right")) - 1
        top, end = max(int(self.begins[item]), g - margin), min(int(self.begins[item + 1]), g + n + margin)
        reach = self.per_mask * errors
        width, shift = 2 * reach + 1, 1 << 20
        at = (np.arange(top, end) - g + k)[:, None] + np.arange(-reach, reach + 1)
        match = (at >= 0) & (at < len(codes))
        match &= codes[np.where(match, at, 0)] == self.words[top:end, None]
        rows = np.arange(end - top, dtype=np.int64)[:, None] * shift
        segment = (~match).cumsum(axis=0, dtype=np.int64)
        big = (end - top + 2) * shift * 8
        none = -big // 4
        best, found = 0, None
        held = np.full(match.shape, none)
        for e in range(errors + 1):
            if e == 0:
                before, gap = np.broadcast_to(np.arange(width, dtype=np.int64), match.shape), None
            else:
                wide = held.copy()
                for s in range(1, self.per_mask + 1):
                    np.maximum(wide[:, s:], held[:, :-s], out=wide[:, s:])
                gap = wide.copy()
                np.maximum(gap[1:, :-1], wide[:-1, 1:] + shift, out=gap[1:, :-1])
                before = np.full(match.shape, none)
                before[1:] = gap[:-1]
            # Along each diagonal: the best beginning of the unbroken run so far.
            run = np.maximum.accumulate(np.where(match, before - rows, none) + segment * big, axis=0) - segment * big
            run = np.where(match & (run > none // 2), run + rows + shift, none)
            least = max(self.min_words, self.per_error * e) * shift
            last = int(run.argmax())
            value = int(run.flat[last])
            if value >= least and value // shift > best:
                i, column = divmod(last, width)
                best = value // shift
                start = (i - best + 1) + int(at[0, 0]) + value % shift
                found = (best, start, int(at[i, column]))
                if best == end - top:
                    break
            held = run if gap is None else np.maximum(run, gap)
        return found

    def find(self, text: str | None) -> list[tuple[object, int, int, int]]:
        """(item id, words of the item found, first and last word of the document) of each leaked item: the longest passage
        about the first of the longest runs that are part of one."""
        if not text or self.automaton is None:
            return []
        letters = self.letters(text)
        if len(letters) < self.min_words - self.min_words // self.per_error:
            return []
        codes = None
        candidates: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for start in range(0, len(letters), BLOCK):
            k, g, n = self._runs(letters, start, start + BLOCK)
            if not len(k):
                continue
            if codes is None:
                codes = _codes(letters)
            chosen = self._promising(codes, k, g, n)
            items = np.searchsorted(self.begins, g[chosen], side="right") - 1
            for number, run in zip(items.tolist(), zip(k[chosen].tolist(), g[chosen].tolist(), n[chosen].tolist())):
                candidates[number].append(run)
        out = []
        for number, runs in candidates.items():
            for k, g, n in sorted(runs, key=lambda r: (-r[2], r[0])):
                short = (n, k, k + n - 1) if n >= self.min_words else self.passage(codes, k, g, n, self.short_errors, self.short - self.seed)
                if short:
                    size = int(self.begins[number + 1] - self.begins[number])
                    full = self.passage(codes, k, g, n, min(MAX_ERRORS, size // self.per_error), MARGIN) if short[0] < size and n < MARGIN else None
                    out.append((self.names[number], *max(short, full or short, key=lambda f: f[0])))
                    break
        return out


def _in_parts(items: DataFrame, item_id: str, item_text: str) -> list[DataFrame]:
    """The items, split by hash into parts of half of PART_BYTES of text on average. Only the parts' sizes reach the driver."""
    size = items.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0))).first()[0]
    pairs = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where(F.col("t").isNotNull())
    if size <= PART_BYTES:
        return [pairs]
    n = -(-size // PART_BYTES) * 2
    part = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    sizes = pairs.groupBy(part.alias("p")).agg(F.sum(F.octet_length("t")).alias("n")).collect()
    if max(r["n"] for r in sizes) > MAX_PART_BYTES:
        raise ValueError(f"an item of more than {MAX_PART_BYTES - PART_BYTES} bytes")
    return [pairs.where(part == r["p"]) for r in sizes]


def leaked(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_words: int = 25,
    per_error: int = 8,
    per_mask: int = 4,
    headers: Sequence[str] = HEADERS,
) -> DataFrame:
    """(doc_id, item_id, n_words, start, end): each document with each item of which it holds a passage; ``n_words`` words
    of the item, at the characters from ``start`` up to ``end`` of the original text.

    One pass over the documents without a shuffle for each PART_BYTES of items. The items are the held-out side: part by part they are
    collected and broadcast. While it is built, an automaton takes about 80 times its text in each worker.
    """
    spark = documents.sparkSession
    doc_type, item_type = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    arrow_item = to_arrow_type(items.schema[item_id].dataType)
    read = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    found = None
    for part in _in_parts(items, item_id, item_text):
        held = spark.sparkContext.broadcast([(r[0], r[1]) for r in part.collect()])
        run = _scan(uuid.uuid4().hex, held, (min_words, per_error, per_mask), tuple(headers), arrow_item)
        here = read.mapInArrow(run, f"doc_id {doc_type}, item_id {item_type}, n_words int, start int, end int")
        found = here if found is None else found.unionByName(here)
    # Repeated ids: the longest passage of each pair.
    longest = F.max_by(F.struct("n_words", "start", "end"), F.struct("n_words", "start", "end")).alias("_found")
    return found.groupBy("doc_id", "item_id").agg(longest).select("doc_id", "item_id", "_found.*")


def _scan(key: str, held, measures: tuple[int, int, int], headers: tuple[str, ...], arrow_item: pa.DataType):
    """The scan of Arrow batches by one part of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(key, held, measures, headers)
        for batch in batches:
            rows = [(i, item, n, *span(t, a, b, scanner.header)) for i, t in enumerate(batch.column("t").to_pylist()) for item, n, a, b in scanner.find(t)]
            ids = batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
            made = [pa.array([r[k] for r in rows], t) for k, t in ((1, arrow_item), (2, pa.int32()), (3, pa.int32()), (4, pa.int32()))]
            yield pa.RecordBatch.from_arrays([ids, *made], ["doc_id", "item_id", "n_words", "start", "end"])

    return run


_SCANNERS: dict[str, Scanner] = {}


def _scanner(key: str, held, measures: tuple[int, int, int], headers: tuple[str, ...]) -> Scanner:
    """One automaton per worker process, kept between tasks."""
    if key not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[key] = Scanner(held.value, *measures, header_lines(headers))
    return _SCANNERS[key]
