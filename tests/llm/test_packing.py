import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from medialedger.llm import packing
from tests.llm.helpers import documents

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " \n\t ", "<|endoftext|> a<|startoftext|>b", "It's we'll 'tis it'S.", "ÀÉß.,; ΟΔΟΣ. İx ﬁ éä!", "a b\x0bc\x1cd e", "x" * 300 + "1234", "Ab## cd$$$ 12.5%", "日本語 テスト。 ½"]


def test_word_by_word_equals_whole_text(spark):
    whole = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("aB é.'#1<|>\n\tß́Σ") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for limit in (300_000, 50):
        ids = packing.WordIds(PATH, limit)
        for t in texts:
            assert np.frombuffer(ids.text(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_tight_and_whole(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(4096, np.maximum(1, rng.lognormal([7, 5, 8, 7.5][seed], 1, size=[3000, 500, 2000, 1][seed]))).astype(np.int64)
    bins, offsets = packing.pack(lengths, 4096)
    assert (bins >= 0).all()
    for b in np.unique(bins):
        mine = np.flatnonzero(bins == b)
        mine = mine[np.argsort(offsets[mine])]
        assert offsets[mine].tolist() == (np.cumsum(lengths[mine]) - lengths[mine]).tolist()
        assert lengths[mine].sum() <= 4096
    # Best-fit decreasing, item by item, as the yardstick.
    free = []
    for x in sorted(lengths.tolist(), reverse=True):
        fits = [f for f in free if f >= x]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - x)
        else:
            free.append(4096 - x)
    assert len(np.unique(bins)) <= 1.03 * len(free) + 8


def test_documents_round_trip(spark):
    whole = Tokenizer.from_file(PATH)
    texts = [*ODD, "word " * 9000, "word " * 4095, "a b c"]
    docs = documents(spark, [*texts, "a b c"], ids=[*range(len(texts)), None]).withColumn("offset", F.lit(1))
    packed = packing.pack_documents(docs, PATH)
    rows = packed.collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    for i, t in enumerate(texts):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["start"] for r in mine] == list(range(0, len(ids), 4096))
        for r in mine:
            part = np.array(ids[r["start"] : r["start"] + 4096], "<u4")
            assert (r["length"], r["ids_crc32"]) == (len(part), zlib.crc32(part.tobytes()))
    assert sum(r["doc_id"] is None for r in rows) == 1
    made = {r["sequence_id"]: np.frombuffer(bytes(r["ids"]), "<u4") for r in packing.sequences(docs.where("doc_id is not null"), packed.where("doc_id is not null"), PATH).collect()}
    assert sum(map(len, made.values())) == sum(r["length"] for r in rows if r["doc_id"] is not None)
    assert packing.pack_documents(documents(spark, []), PATH).collect() == []
