"""Byte-level BPE against the tiktoken library and against single merges."""

import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken

from reelmill.llm import bpe, words

from .common import frame, sample

RAW = open(bpe.RANKS, "rb").read()
LIBRARY = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}, special_tokens={})


def block_ids(coder, texts):
    out = []
    for block in words.blocks(pa.array(texts, pa.string())):
        ids, at = coder.block(block)
        out += [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])]
    return out


def one_by_one(ranks, piece):
    """The leftmost pair of least rank, again and again."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [bytes([b]) for b in piece]
    while True:
        found = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if found is None:
            return [ranks[p] for p in parts]
        i = found[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


ODD = [
    "", "a", " ", "  ", "\n\n  x", "don't we'll I'M", "x" * 129, "x" * 5000, "ab" * 700, "漢字かな交じり文" * 80, "🎉👩‍👩‍👧 é ñ", "\x00\x01\x1c\x1d\x1e\x1f\x85\xa0 　 z", "<|endoftext|>", "1234567890" * 40,
    "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=20000)), "".join(random.Random(2).choices("0123456789abcdef", k=3000)), "=" * 3000, "Ünïcödé" * 50, " \t \n \r\n tail  ", "ﬁ ǅ ⅷ ² ½ ٣",
]


def test_same_as_the_library():
    texts = ODD + [t or "" for _, t in sample()]
    assert block_ids(bpe.Encoder(RAW, bpe.PATTERN), texts) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_every_character_is_cut_as_by_the_library():
    texts = ["".join(f"{chr(c)}a {chr(c)}{chr(c)}1" for c in range(i, min(i + 64, 0x3400)) if not 0xD800 <= c < 0xE000) for i in range(0, 0x3400, 64)]
    assert block_ids(bpe.Encoder(RAW, bpe.PATTERN), texts) == [LIBRARY.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("seed", range(12))
def test_any_ranks_by_single_merges(seed):
    """Ranks in any order, so that merges make pairs of lower rank; short rows, long rows and ties of one token cut in two ways."""
    rng = random.Random(seed)
    tokens = [bytes([b]) for b in range(256)]
    more = {bytes(rng.choices(b"abc", k=rng.randint(2, 6))) for _ in range(60)}
    rest = sorted(more)
    rng.shuffle(rest)
    ranks = {t: i for i, t in enumerate(tokens + rest)}
    raw = b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items())
    vocabulary = bpe.Vocabulary(raw)
    pieces = [bytes(rng.choices(b"abc", k=k)) for k in [1, 2, 3, 5, 8, 13, 64, 65, 127, 128, 129, 300, 900] for _ in range(4)]
    pieces = [p for p in pieces if p not in ranks]
    assert [x.tolist() for x in vocabulary.merged(pieces)] == [one_by_one(ranks, p) for p in pieces]
    assert [vocabulary.merge_row(vocabulary.byte_ids[np.frombuffer(p, np.uint8)]).tolist() for p in pieces if len(p) > 1] == [one_by_one(ranks, p) for p in pieces if len(p) > 1]


def test_long_runs_end_soon():
    import time

    coder = bpe.Encoder(RAW, bpe.PATTERN)
    began = time.time()
    texts = ["x" * 3_000_000, "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyz", k=400_000))]
    ids = block_ids(coder, texts)
    assert time.time() - began < 60
    assert ids == [LIBRARY.encode_ordinary(t) for t in texts]
    assert not coder.known or coder.bytes <= coder.KEPT_BYTES


def test_what_is_kept_is_bounded():
    coder = bpe.Encoder(RAW, bpe.PATTERN)
    coder.KEPT = 10
    texts = [f"word{i} again{i}" for i in range(50)]
    assert block_ids(coder, texts) + block_ids(coder, texts) == 2 * [LIBRARY.encode_ordinary(t) for t in texts]
    assert len(coder.known) <= 10


def test_encode_decode_and_digests(spark):
    rows = [*sample(), *((1000 + i, t) for i, t in enumerate(ODD)), (7, "twice"), (7, "twice"), (None, "no id")]
    docs = frame(spark, rows).withColumnRenamed("part", "token_ids").withColumnRenamed("score", "decoded")
    got = bpe.decode(bpe.encode(docs)).collect()
    wanted = {t: LIBRARY.encode_ordinary(t or "") for _, t in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r.token_ids == wanted[r.text] and bytes(r.decoded) == (r.text or "").encode() and r.row == "r"
    digests = bpe.round_trip(docs)
    assert digests.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    brute = sorted(str((i, len(wanted[t]), sha(" ".join(map(str, wanted[t])).encode()), sha((t or "").encode()))) for i, t in rows)
    assert sorted(str(tuple(r)) for r in digests.collect()) == brute
    assert bpe.round_trip(docs.limit(0)).count() == 0 and bpe.decode(bpe.encode(docs.limit(0))).count() == 0


def test_other_ranks(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    other = tiktoken.Encoding("other", pat_str=bpe.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb").read().splitlines())}, special_tokens={})
    docs = frame(spark, list(enumerate(ODD)))
    assert {r.doc_id: r.token_ids for r in bpe.encode(docs, ranks=path).collect()} == {i: other.encode_ordinary(t) for i, t in enumerate(ODD)}
    with pytest.raises(Exception, match="no token"):
        bpe.decode(spark.createDataFrame([(1, [999_999])], "doc_id long, token_ids array<int>")).collect()


def test_whole_table(spark):
    from reelmill.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.queries()["op11_byte_bpe"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode_bytes(ids)).hexdigest())
