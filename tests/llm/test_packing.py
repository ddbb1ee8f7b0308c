import json
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tierwave.llm.packing import encoder, pack, pack_digest, quick_encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 0]


def test_pieces_are_the_ids(make, odd):
    odd = [*odd, (50, "a <|endoftext|> b"), (51, "x<|endoftext|>y  <|endoftext|><|endoftext|>\n z <|endo")]
    rows = [(i + 100 * k if i is not None else None, t) for k in range(2) for i, t in odd]
    got = pack(make(rows), PATH, 64).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r.sequence_id * 64 + r.offset):
        by[r.doc_id].append(r)
    for doc in {i for i, _ in rows}:
        texts = [t for i, t in rows if i == doc]
        want = sorted(ids_of(t) for t in texts)
        found, at = [], None
        for r in by[doc]:
            if r.start == 0:
                found.append([])
            assert r.start == len(found[-1])
            found[-1] += r.ids
            assert r.doc_tokens >= len(found[-1])
        assert sorted(found) == want
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    at = 0
    for s, o, n in places:
        assert s * 64 + o == at and n > 0 and o + n <= 64
        at += n


def test_digest(make, odd):
    docs = make([(i, t) for i, t in odd if i is not None and i != 3])
    whole = {(r.doc_id, r.start): (zlib.crc32(np.array(r.ids, "<u4").tobytes()), r.length, r.sequence_id, r.offset) for r in pack(docs, PATH).collect()}
    assert {(r.doc_id, r.start): (r.ids_crc32, r.length, r.sequence_id, r.offset) for r in pack_digest(docs, PATH).collect()} == whole


def test_empty(make):
    assert pack(make([]), PATH).count() == 0


def test_quick_ids_are_the_tokenizers():
    texts = ["a\t\n foo  bar\n\nbaz ", "x\x1c y\x85 z\xa0\xa0w", "don't  stop\r\n\r\n 1234 %%%  <|endoftext|> é", "   ", "\u2028a\u3000 b", "", "aaaaaaa" * 99, "x" + " " * 1_000_001 + "y"]
    assert encoder(PATH).quick is not None
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder(PATH).encode(texts)] == [ids_of(t)[:-1] for t in texts]


def test_quick_ids_of_every_code_point():
    enc, points = encoder(PATH), [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 64):
        text = "|".join(f"a{chr(c)}1{chr(c)}. {chr(c)} x  {chr(c)}\n" for c in points[i : i + 64])
        assert enc.quick.encode_ordinary(text) == enc.tokenizer.encode(text, add_special_tokens=False).ids, points[i]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r\x85\xa0'stredmvl019.,-"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_quick_ids_of_any_text(text):
    assert encoder(PATH).ids(text) == ids_of(text)[:-1]


def test_other_vocabularies_have_no_quick_encoder():
    path = public_tokenizers.path("word_bpe_49k.json")
    enc = encoder(path)
    assert enc.quick is None and enc.ids("Some words, <|endoftext|>") == Tokenizer.from_file(path).encode("Some words, <|endoftext|>", add_special_tokens=False).ids
    spec = json.loads(encoder(PATH).tokenizer.to_str())
    spec["model"]["merges"].reverse()
    assert quick_encoder(spec) is None


def test_tokens_that_merges_do_not_reach_have_no_quick_encoder():
    """`abc` is a token, but its bytes end as a and bc: the tokenizer gives two ids, merge ranks would give one."""
    spec = json.loads(encoder(PATH).tokenizer.to_str())
    single = {k: v for k, v in spec["model"]["vocab"].items() if len(k) == 1}
    letters = {k: i for i, k in enumerate(sorted(single, key=single.get))}

    def made(merges):
        vocab = letters | {a + b: len(letters) + i for i, (a, b) in enumerate(merges)}
        return spec | {"added_tokens": [], "model": spec["model"] | {"vocab": vocab, "merges": [list(m) for m in merges]}}

    assert len(letters) == 256
    assert quick_encoder(made([("b", "c"), ("a", "b"), ("ab", "c")])) is None
    good = made([("a", "b"), ("ab", "c"), ("b", "c")])
    quick, slow = quick_encoder(good), Tokenizer.from_str(json.dumps(good))
    for text in ("abc", "bc abcc", "aabbcc abab", "cab"):
        assert quick.encode_ordinary(text) == slow.encode(text, add_special_tokens=False).ids
