"""Memory of the Python workers."""

import re
from pathlib import Path

import numpy as np
import pyarrow as pa

from flagstone.llm import common


def held_mb():
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def costly(batches):
    """The batches as they are, each with many pieces of Arrow memory taken and given back meanwhile."""
    for batch in batches:
        taken = [pa.array(np.ones(1 << 16)) for _ in range(256)]
        copies = [pa.concat_arrays([a, a]) for a in taken]  # 256 MB
        del taken, copies
        yield batch


def test_a_worker_gives_unused_arrow_memory_back(spark):
    def measured(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([held_mb()])], names=["mb"])

    rows = spark.range(0, 40, 1, 4)
    assert common.in_arrow(rows, costly, "id long").count() == 40
    assert sorted(r.id for r in common.in_arrow(rows, costly, "id long").collect()) == list(range(40))
    assert max(r.mb for r in rows.mapInArrow(measured, "mb double").collect()) < 200
