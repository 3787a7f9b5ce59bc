import base64
import hashlib
import random

import pytest

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F

from sightline.llm.bpe import Codec, Utf8, encode_documents, load_ranks  # noqa: E402

DATA = open(P.path("byte_bpe_50k.tiktoken")).read()


@pytest.fixture(scope="module")
def both():
    ranks = load_ranks(DATA)
    return Codec(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ranks_are_the_file():
    assert load_ranks(DATA)[base64.b64decode(DATA.split()[0])] == int(DATA.split()[1])


def test_same_as_library(both):
    codec, lib = both
    rnd = random.Random(3)
    alphabet = "aábcdeéfghiñ ,.'\n\t\u00a0\u200912345{}()[]<>=*#日本語🙂ﬀ\u0301sStThH"
    texts = ["", " ", "   x", "a", "'s don't", "x" * 3000, "ab" * 500, "🙂" * 40, "  \n\n  end  "]
    texts += ["".join(rnd.choices(alphabet, k=rnd.randint(1, 200))) for _ in range(1500)]
    texts += ["".join(rnd.choices("etaoinshr", k=rnd.randint(1, 60))) for _ in range(3000)]
    for t in texts:
        got = [i for b in codec.encode(t) for i in b]
        assert got == lib.encode_ordinary(t), t
        assert "".join(codec.decode([got])) == t


def test_transducer_equals_merging(both):
    machine = both[0].machine
    rnd = random.Random(5)
    for _ in range(2000):
        piece = bytes(rnd.choices(range(256), k=rnd.randint(1, 12))) if rnd.random() < 0.5 else "".join(rnd.choices("theandingr ", k=rnd.randint(1, 25))).encode()
        assert machine.encode(piece) == ([machine.ranks[piece]] if piece in machine.ranks else machine.merged(piece))


def test_few_states_at_most(both):
    from sightline.llm.bpe import Transducer

    small = Transducer(both[0].machine.ranks, max_states=50)
    for w in ("unbelievable", "schpfverbeung", "reconstruction", "zzzzqqqq") * 3:
        assert small.encode(w.encode()) == both[0].machine.encode(w.encode())


def test_long_text_in_blocks(both, monkeypatch):
    import sightline.llm.bpe as bpe

    codec, lib = both
    monkeypatch.setattr(bpe, "BLOCK", 100)
    t = "word one  two\n three's " * 300 + "x" * 500
    blocks = list(codec.encode(t))
    assert len(blocks) > 5 and [i for b in blocks for i in b] == lib.encode_ordinary(t)


def test_utf8_machine_any_cut():
    t = "aé日🙂z" * 20
    data = t.encode()
    for step in (1, 2, 3, 5, 7):
        u = Utf8()
        assert "".join(u.feed(data[i : i + step]) for i in range(0, len(data), step)) + u.finish() == t


def test_documents(spark, both):
    lib = both[1]
    rows = [(1, "Hello wörld", "x"), (2, None, None), (3, "", "y"), (4, "Hello wörld", "z"), (None, "a b", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in encode_documents(df, DATA, P.PATTERN).collect()}
    for i, t, _ in rows:
        ids = lib.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids) and got[i].token_ids == ids
        assert got[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert encode_documents(df.limit(0), DATA, P.PATTERN).count() == 0


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([("a b",), (None,)], "text string").select("text", *(F.lit("own").alias(c) for c in ("_text", "_c0", "n_tokens", "a.b")))
    out = encode_documents(df, DATA, P.PATTERN)
    assert {r["_text"] for r in out.collect()} == {r["_c0"] for r in out.collect()} == {r["a.b"] for r in out.collect()} == {"own"} and sorted(r.n_tokens for r in out.collect()) == [0, 2]
