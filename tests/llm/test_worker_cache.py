import pyarrow as pa

from flowseq.llm import toxicity
from flowseq.llm.common import worker_cache


def test_a_worker_keeps_the_cache_of_one_operator():
    worker_cache("packing")["word"] = b"ids"
    assert worker_cache("packing") == {"word": b"ids"}
    assert [len(x) for x in next(iter(toxicity._hash_terms(iter([pa.array(["a b a"])]))))] == [2]
    assert worker_cache("packing") == {}
