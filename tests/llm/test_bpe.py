import base64
import hashlib
import random

import numpy as np
import pytest

from textloom.llm import bpe

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = P.path("byte_bpe_50k.tiktoken")


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(7)
    odd = lambda: chr(r.choice([r.randrange(32, 127), r.randrange(0, 0x3000), r.randrange(0x1F000, 0x1FFFF), 32, 10, 0x1C, 0x85]))
    out = ["", " ", "a", "x" * 700, "ab" * 3000, " " * 900 + "q", "é" * 300, "<|endoftext|>", "don't DON'T we'll", "\r\n\t ½ 12３４ 日本語"]
    return out + ["".join(odd() for _ in range(r.randrange(1, 200))) for _ in range(200)]


def test_ids_equal_the_library_and_round_trip():
    own, want = bpe.Codec(PATH, P.PATTERN), library()
    for _ in range(2):  # the second time from the cache
        ids, offsets = own.encode_texts(texts())
        for k, t in enumerate(texts()):
            part = ids[offsets[k] : offsets[k + 1]]
            assert part.tolist() == want.encode_ordinary(t), t
            assert own.decode(part) == t.encode()


def test_long_rows_and_matrices_agree():
    own, r = bpe.Codec(PATH, P.PATTERN), random.Random(3)
    for _ in range(100):
        piece = bytes(r.choice(b"etaoin shrdlu\xc3\xa9") for _ in range(r.randrange(1, 100)))
        assert own._row(piece).tolist() == own._matrix([piece])[0].tolist()


def test_long_pieces_equal_the_library():
    own, want, r = bpe.Codec(PATH, P.PATTERN), library(), random.Random(5)
    of = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    long = [of("ab", 3000), of("abc", 2000), of("etaoinshrdlu", 5000), of("ABCDEFabcdefXYZ", 4000), "=-" * 2000, of("-=_.", 3000), "a" * 9999, "the" * 1500, of("日本語é", 900), of("ing", 4000), of("0123456789", 2000)]
    long += [of(r.choice(["an", "ent", "ion", "aeiou", "xyzzy", "lol"]), r.randrange(129, 700)) for _ in range(150)]
    ids, offsets = own.encode_texts(long)
    for k, t in enumerate(long):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == want.encode_ordinary(t), t[:50]


def test_merges_that_make_lower_ranks(tmp_path):
    """Ranks where merging two places at once would be wrong: ab is 258, aba 257."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ba": 256, b"aba": 257, b"ab": 258, b"abab": 259}
    swapped = ranks | {b"ba": 258, b"ab": 256 + 4}
    for k, own in enumerate((ranks, swapped, {bytes([b]): b for b in range(256)} | {b"aba": 256, b"ab": 257})):
        path = tmp_path / f"{k}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for t, i in own.items()))
        codec = bpe.Codec(str(path), r"[a-z]+|[^a-z]+")
        r = random.Random(k)
        for n in (2, 3, 5, 8, 40, 300):
            for _ in range(20):
                piece = bytes(r.choice(b"aab") for _ in range(n))
                assert codec._row(piece).tolist() == codec._matrix([piece])[0].tolist(), piece


def test_rows_with_nulls_repeats_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "Hello there", 5), (1, "Hello there", 5), (2, None, 6), (None, "", None)], "doc_id long, text string, N_TOKENS int")
    rows = bpe.digests(df, PATH, P.PATTERN).collect()
    assert sorted(r.n_tokens for r in rows) == [0, 0, 2, 2]
    none = hashlib.sha256(b"").hexdigest()
    assert {r.decoded_sha256 for r in rows if not r.text} == {none} == {r.ids_sha256 for r in rows if not r.text}
    one = next(r for r in rows if r.text)
    assert one.ids_sha256 == hashlib.sha256(np.array(library().encode_ordinary("Hello there"), "<u4").tobytes()).hexdigest()
    back = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(df, PATH, P.PATTERN).count() == 0
