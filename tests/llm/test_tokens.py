import zlib
from itertools import chain

import numpy as np
import pytest
from conftest import DOC
from tokenizers import Tokenizer

from sedimenta.llm import token_counts as c
from sedimenta.llm import token_pack as p
from sedimenta.llm.tokens import ChunkEncoder, default_vocabulary


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 32])
def test_pack_round_trip_and_random_access(bits, tmp_path):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 10_001, dtype=np.uint64).astype(np.uint32)
    assert (p.unpack(p.pack(ids, bits), len(ids), bits) == ids).all()
    path = tmp_path / "x"
    with path.open("wb") as f:
        w = p.PackedWriter(f, bits, block_ids=64)
        for i in range(0, len(ids), 777):
            w.write(ids[i : i + 777])
        w.close()
    import pyarrow as pa

    with pa.OSFile(str(path)) as f:
        r = p.PackedReader(f)
        for a, b in ((0, 1), (63, 65), (100, 5000), (9990, 10_001), (5, 5)):
            assert (r.read(a, b) == ids[a:b]).all()
    if bits < 32:
        with pytest.raises(ValueError):
            p.pack(np.array([1 << bits], np.uint64), bits)


TEXTS = ["Hello, World!", "it's  don't we'LL", "é́ naïve ÉCOLE İstanbul", "a<|endoftext|>b <|ENDOFTEXT|>", "x,y.z; (q) 12,345 ...!", "tab\tnl\nnbsp em  zero​", "", " ", "ΣΑΣ ǅ ﬁ ½ ١٢", "a" * 500]


def test_chunked_encoding_equals_the_library(monkeypatch):
    from sedimenta.llm import tokens

    library, own = Tokenizer.from_file(default_vocabulary()), ChunkEncoder(default_vocabulary())
    monkeypatch.setattr(tokens, "REMEMBERED", 10)
    for _ in range(3):
        ids, offsets = own.encode([t.encode() for t in TEXTS], None)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [library.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_token_report(spark, docs, no_docs):
    library = Tokenizer.from_file(default_vocabulary())
    got = sorted((tuple(r) for r in p.token_report(docs.withColumnRenamed("lang", "t")).collect()), key=lambda r: r[1])
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    want, start = [], 0
    for r in rows:
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert p.token_report(no_docs).count() == 0


@pytest.mark.parametrize("block", [2, 64, 4 << 20])
def test_counts_of_flat_files(spark, docs, block):
    library = Tokenizer.from_file(default_vocabulary())
    library.encode_special_tokens = True
    extra = spark.createDataFrame([(50, "a <|endoftext|> b", None, None, 1)], DOC)
    rows = docs.where("doc_id is null or doc_id <> 9").unionByName(extra)
    got = sorted((r.doc_id or 0, r.n_tokens) for r in c.count_documents(rows, block_bytes=block).collect())
    assert got == sorted((r.doc_id or 0, len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in rows.collect())


def test_unfinished_and_empty_files(spark, no_docs, tmp_path):
    for name, ids in (("a", [5, 9, 9, 7]), ("b", []), ("c", [9]), ("d", [1, 2, 3])):
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    files = spark.createDataFrame([(n,) for n in "abcd"], "file string")
    for block in (2, 4, 1 << 20):
        got = sorted(tuple(r) for r in c.count_flat(files, f"file://{tmp_path}", 2, 9, block_bytes=block).collect())
        assert got == [("a", 0, 0, 1, True), ("a", 1, 2, 0, True), ("a", 2, 3, 1, False), ("c", 0, 0, 0, True), ("d", 0, 0, 3, False)]
    assert c.count_documents(no_docs).count() == 0


def test_characters_are_composed_before_they_are_lowered():
    library, own = Tokenizer.from_file(default_vocabulary()), ChunkEncoder(default_vocabulary())
    texts = [f"a{c} Word a{c}, {c.lower()}" for c in ("H̱", "T̈", "W̊", "Y̊", "J̌")]
    ids, offsets = own.encode([t.encode() for t in texts], None)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_composition_with_an_ascii_letter_has_the_lead_bytes():
    import unicodedata

    parts = {c: unicodedata.normalize("NFD", c) for c in map(chr, chain(range(0x80, 0xD800), range(0xE000, 0x110000)))}
    joining = {x for p in parts.values() if p[0].isascii() for x in p[1:]}
    assert "\u0301" in joining
    for c, p in parts.items():
        if p[0] in joining:
            assert c.encode()[0] in (0xCC, 0xCD), hex(ord(c))


def test_new_chunks_go_through_the_library_together():
    """Capitals beside accents are the same chunks; unseen chunks share texts, also beside marks and rare signs."""
    library, own = Tokenizer.from_file(default_vocabulary()), ChunkEncoder(default_vocabulary())
    texts = ["Élan Vital naïve", "élan vital NAÏVE", "a\x01b \x01 plain words, \x01\x01", "Word word, word. Word; 12: 12 , ,", " ".join(f"Wörd{i}, word{i}!" for i in range(700)), "K\u212a \u0301x e\u0301"]
    calls, batch = [], own.tokenizer.encode_batch_fast

    class Counted:
        def __getattr__(self, name):
            return getattr(library, name)

        def encode_batch_fast(self, texts, **options):
            calls.append(len(texts))
            return batch(texts, **options)

    own.tokenizer = Counted()
    for text in texts:
        ids, _ = own.encode([text.encode()], None)
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert own.chunks(texts[0].encode())[1] == b"vital" and max(calls) < 20
