"""A first-in, first-out queue of tasks for the chunks of a schedule."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Row


@dataclass
class Task:
    task_id: str
    payload: dict[str, Any] = field(default_factory=dict)


class TaskQueue:
    def __init__(self) -> None:
        self._tasks: deque[Task] = deque()

    def enqueue(self, task: Task) -> None:
        self._tasks.append(task)

    def dequeue(self) -> Task | None:
        """The oldest task; None of an empty queue."""
        return self._tasks.popleft() if self._tasks else None

    @classmethod
    def of_chunks(cls, chunks: Iterable[Row]) -> TaskQueue:
        """A task for each row of a schedule's chunks, named by scene and worker."""
        queue = cls()
        for row in chunks:
            queue.enqueue(Task(f"{row['scene_id']}/{row['worker_id']}", row.asDict()))
        return queue

    def size(self) -> int:
        return len(self._tasks)
