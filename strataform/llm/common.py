"""What the operators of this subpackage share: the shared work folder, bounded memos, word splitting."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import SparkSession

from strataform.session import ship
from strataform.storage import _local, get, put, work_dir, written  # noqa: F401

#: A word is a run of anything but these bytes (space and the ASCII controls 9 to 13).
WORD = r"[^\x20\x09-\x0D]+"


#: Rows that go to a Python worker at a time, for texts are long: set where the session has Spark's default.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, and this package on the executors."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, ARROW_ROWS)
    ship(spark)


def partitions(spark: SparkSession) -> int:
    """Tasks after a shuffle, as the session sizes them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_held: dict = {}


def held(key, make: Callable):
    """One heavy object of a Python worker (a codec with its memo, a model), kept over tasks until another is asked for.

    Workers outlive stages; without this each operator's memo would stay beside the next one's.
    """
    if key not in _held:
        _held.clear()
        gc.collect()
        _held[key] = make()
    return _held[key]


class Memo(dict):
    """A cache of ``make(key)`` of two generations: at most 2 * ``size`` entries, the least used of which go.

    ``memo[key]`` computes what is missing, so ``map(memo.__getitem__, keys)`` runs at C speed on hits.
    Keys longer than ``longest`` are computed each time and never stored.
    """

    def __init__(self, make: Callable, size: int = 250_000, longest: int = 64):
        super().__init__()
        self.make, self.size, self.longest, self.old = make, size, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        self[key] = value
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()
        return value


class Files(dict):
    """Unpacked files of the shared folder by path, through ``make``, at most so many and of so many bytes.

    Those asked for longest ago go first. A mapped file counts for its place only: its pages are the system's.
    """

    def __init__(self, make: Callable = lambda parts: parts, size: int = 256 << 20, files: int = 10_000):
        super().__init__()
        self.make, self.size, self.files, self.held = make, size, files, 0

    def __missing__(self, path: str):
        raw = get(path)
        self.held += (cost := 0 if _local(path) else raw.nbytes)
        self[path] = cost, self.make(unpack(raw))
        while len(self) > 1 and (self.held > self.size or len(self) > self.files):
            self.held -= self.pop(next(iter(self)))[0]
        return self[path]

    def open(self, path: str):
        if path in self:
            self[path] = self.pop(path)  # to the end
        return self[path][1]


def pack(arrays: dict) -> bytes:
    """Named arrays as one block of bytes, each aligned to 8; ``unpack`` makes views of it."""
    import json

    import numpy as np

    parts, at, names = [], 0, {}
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        names[name] = [a.dtype.str, len(a), at]
        parts.append(raw + b"\0" * (-len(raw) % 8))
        at += len(parts[-1])
    head = json.dumps(names).encode()
    head += b" " * (-(len(head) + 8) % 8)
    return b"".join([len(head).to_bytes(8, "little"), head, *parts])


def unpack(block) -> dict:
    import json

    import numpy as np

    n = int.from_bytes(block[:8].tobytes(), "little")
    names = json.loads(block[8 : 8 + n].tobytes())
    body = block[8 + n :]
    return {k: body[at : at + count * np.dtype(t).itemsize].view(t) for k, (t, count, at) in names.items()}
