"""Token files and packing against a plain tokenizer loop."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leakfree.llm import packing, token_files
from leakfree.llm.common import documents, shared_path
from leakfree.llm.tokens import Encoder, tokenizer_path
from tests.llm import cases

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abAB.,'<|>sStT \n\téÉßİΣſ0123́"), st.characters()), max_size=60), max_size=8))
def test_encoder_equals_tokenizer(texts):
    e = _encoder()
    t = e.tokenizer
    for text, ids in zip(texts, e.encode(texts)):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids


def _encoder(found=[]):  # noqa: B006  one for all examples, so that its tables are used
    if not found:
        found.append(Encoder(tokenizer_path()))
    return found[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=400))
def test_elias_fano(lengths):
    v = np.cumsum(lengths)
    e = token_files.EliasFano.of(v)
    assert e.all().tolist() == v.tolist()
    assert [e.select(i) for i in range(len(v))] == v.tolist()


def test_elias_fano_is_small():
    v = np.cumsum(np.random.default_rng(1).integers(1, 2000, 8192))
    e = token_files.EliasFano.of(v)
    assert 8 * (len(e.lower) + len(e.upper) + len(e.samples)) / len(v) < 2 + np.log2(v[-1] / len(v)) + 1


@pytest.mark.parametrize("block_ids", [1 << 20, 500])
def test_token_files(spark, plain, block_ids):
    for docs in (cases.frame(spark), documents(spark, SF)):
        path = shared_path(spark, "t")
        token_files.write(docs, path, block_ids=block_ids)
        got = token_files.read(spark, path).collect()
        want = Counter()
        starts = defaultdict(list)
        for r in docs.select("doc_id", "text").collect():
            ids = plain(r.text) + [2]
            want[(r.doc_id, len(ids), crc(ids))] += 1
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
        at = 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens
            starts[r.doc_id].append(r.start)
        order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
        assert order == sorted(order, key=lambda x: (x is not None, x))


def test_one_document_of_a_block(spark, plain):
    path = shared_path(spark, "t")
    docs = documents(spark, SF)
    token_files.write(docs, path)
    texts = {r.doc_id: r.text for r in docs.collect()}
    block = spark.read.parquet(path).first().asDict()
    for i in (0, len(block["doc_ids"]) // 2, len(block["doc_ids"]) - 1):
        assert token_files.slice_of(block, i).tolist() == plain(texts[block["doc_ids"][i]]) + [2]


def test_no_rows(spark):
    path = shared_path(spark, "t")
    token_files.write(cases.empty(spark), path)
    assert token_files.read(spark, path).count() == 0
    assert packing.pack_documents(cases.empty(spark)).count() == 0


def check_packed(got, docs, plain, size):
    parts = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = plain(r.text) + [0]
        for i, s in enumerate(range(0, len(ids), size)):
            parts[(r.doc_id, i, s, len(ids[s:s + size]), crc(ids[s:s + size]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == parts
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for spans in seqs.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= size
    return len(seqs)


def test_packing(spark, plain):
    docs = cases.frame(spark)
    check_packed(packing.pack_documents(docs, size=64).collect(), docs, plain, 64)
    check_packed(packing.pack_documents(docs, size=64, open_bins=2).collect(), docs, plain, 64)
    docs = documents(spark, "/root/testdata/sf0.01")
    got = packing.pack_documents(docs).collect()
    n = check_packed(got, docs, plain, 2048)
    assert n <= 1.03 * sum(r.length for r in got) / 2048 + 8  # eight partitions end with a part-full one


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=300), st.integers(1, 8))
def test_open_bins_against_a_plain_search(lengths, limit):
    bins, rooms, made = packing.OpenBins(50, limit), {}, 0
    for n in lengths:
        number, offset = bins.place(n)
        fit = [r for r in rooms.values() if r >= n]
        if fit:  # best fit: the least room that is enough
            assert rooms[number] == min(fit)
            room = rooms.pop(number)
        else:
            assert number == made
            room, made = 50, made + 1
        assert offset == 50 - room
        if room > n:
            rooms[number] = room - n
        if len(rooms) > limit:  # the fullest closes first
            least = min(rooms.values())
            assert bins.count == limit
            open_now = {b for space in bins.free for b in space}
            gone = next(b for b in rooms if b not in open_now)
            assert rooms.pop(gone) == least
        assert {b for space in bins.free for b in space} == set(rooms)
