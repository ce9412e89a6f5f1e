import os

import pytest

from kolonna.llm.queries import ORACLES, QUERIES
from tests.oracle import DATA, connect, same

FOLDER = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    frame = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        same(db, frame, ORACLES[name])
    else:
        assert frame.count() > 0


def test_token_containers_hold_every_text(spark):
    import public_tokenizers

    from kolonna.llm.packing import bpe_counter
    from kolonna.llm.queries import TOKENS
    from tests.llm.test_packing import check

    count = bpe_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    load = check(QUERIES["p6_token_containers"](spark, FOLDER).collect(), texts, TOKENS, lambda t: count([t])[0])
    fills = {r.container: r.used for r in QUERIES["p6_token_fill"](spark, FOLDER).collect()}
    assert sorted(fills.values()) == sorted(load.values())
