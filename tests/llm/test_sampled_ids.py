"""The sampling query returns the sampled segmentations themselves."""

import zlib

import numpy as np

from millrace.llm import queries as Q


def test_ids(spark, sf):
    r = Q.op10_sampling(spark, sf).toPandas()
    assert len(r) and all((len(x.ids), zlib.crc32(np.array(x.ids, "<u4").tobytes())) == (x.n_tokens, x.ids_crc32) for x in r.itertuples())
