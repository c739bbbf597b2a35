"""Candidate pairs of signatures: the loop that makes them is compiled, and each is found once."""

import numpy as np
import pytest

from binmine.operators import sketch
from binmine.plans import registry

SF = "/root/testdata/sf0.001"
#: Bytes of a method beyond which the JVM only interprets it.
HUGE = 8000


def generated(spark, df):
    """The text and the size of the largest method of each generated stage of df's plan as it was run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    stages = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$").__getattr__("MODULE$").codegenStringSeq(plan)
    return [(stages.apply(i)._1(), stages.apply(i)._3().maxMethodCodeSize()) for i in range(stages.size())]


def test_pairs_are_made_in_a_compiled_loop(spark):
    """The methods of the query's join stay below the size that the JVM compiles; of 15,513 bytes they were interpreted."""
    joins = [size for text, size in generated(spark, registry.QUERIES["lsh_candidate_pairs"](spark, SF)) if "id1" in text and "Join" in text]
    assert joins and max(joins) < HUGE


@pytest.mark.parametrize("p", [None, 8])
@pytest.mark.parametrize("part", [11, 4096])
def test_pairs_of_bands_as_numbers_and_as_arrays(spark, part, p):
    """Copies, a null id, hashes of no item (-1), bands of unlike sizes and buckets of several parts: each pair once."""
    rng = np.random.default_rng(11)
    sig = rng.integers(-1, 3, (150, 5))
    sig[100:] = sig[rng.integers(0, 20, 50)]
    rows = [(None if i == 40 else int(x), s) for i, (x, s) in enumerate(zip(rng.permutation(5000)[:150], sig.tolist(), strict=True))]
    ends = [(0, 3), (3, 5)]
    known = [r for r in rows if r[0] is not None]
    want = sorted((a, b) for a, x in known for b, y in known if a < b and any(x[i:j] == y[i:j] for i, j in ends))
    sigs = spark.createDataFrame(rows, "id long, sig array<long>").repartition(3)
    assert sorted(map(tuple, sketch.signature_pairs(sigs, 5, 2, part, p).collect())) == want
