"""Loading rows into a service that may time out after it has committed: nothing is sent twice, and a shortfall is an error."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys asked for at once when it is looked up what is there.
WINDOW = 60


def present(keys: Iterable[str], exists: Callable[[list[str]], set[str]]) -> set[str]:
    """Which keys are there. An answer with keys that weren't asked for shows that the filter was ignored, which is an error."""
    asked, found = list(keys), set()
    for at in range(0, len(asked), WINDOW):
        part = asked[at : at + WINDOW]
        got = exists(part)
        if not got <= set(part):
            raise ValueError("the service ignores the filter on keys")
        found |= got
    return found


def load(rows: DataFrame, key: str, send: Callable[[list[dict]], None], exists: Callable[[list[str]], set[str]], batch: int = 200, attempts: int = 4, pause: float = 0.1) -> int:
    """Sends rows (one a key) in batches, as many tasks at once as rows has partitions; gives how many were sent.

    What is there already isn't sent. After a failed call it is looked up what of the batch got through
    all the same, and only the rest is tried again; after the last attempt, or with rows short in the end, it is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = short = 0
        for b in batches:
            all_ = b.to_pylist()
            for at in range(0, len(all_), batch):
                part = all_[at : at + batch]
                there = present((str(r[key]) for r in part), exists)
                left = [r for r in part if str(r[key]) not in there]
                for trial in range(attempts):
                    if not left:
                        break
                    before = len(left)
                    try:
                        send(left)
                        left = []
                    except OSError:
                        time.sleep(pause * 2**trial)
                        there = present((str(r[key]) for r in left), exists)
                        left = [r for r in left if str(r[key]) not in there]
                    sent += before - len(left)
                short += len(left)
        yield pa.RecordBatch.from_arrays([pa.array([sent]), pa.array([short])], names=["sent", "short"])

    sent, short = rows.dropDuplicates([key]).mapInArrow(run, "sent long, short long").agg(F.sum("sent"), F.sum("short")).first()
    if short:
        raise ValueError(f"{short} rows were not written")
    return sent or 0


def progress(path: str) -> dict[str, int]:
    return json.loads(Path(path).read_text()) if Path(path).exists() else {}


def keep_progress(path: str, **counts: int) -> None:
    """Writes counts beside those kept, by a rename, so that a file is whole or as it was."""
    new = f"{path}.new"
    Path(new).write_text(json.dumps(progress(path) | counts, sort_keys=True))
    os.replace(new, path)


def resume_point(path: str, name: str, present: int) -> int:
    """How many rows of a load are there already: the kept count or what the target has, whichever is more. A count is kept late, and a target may have been filled otherwise; rows below it need no call."""
    return max(progress(path).get(name, 0), present)
