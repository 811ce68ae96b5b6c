import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weft.llm.token_files import Encoder, Reader, Writer, output_folder, pack, read, unpack, write

PATH = public_tokenizers.path("byte_bpe_50k.json")


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_blocks_and_files_round_trip(planes):
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 1000):
        ids = rng.integers(0, 2**32, n, dtype=np.uint32) if n % 2 else rng.integers(0, 300, n, dtype=np.uint32)
        parts = pack(ids, planes)
        assert len(parts) == (4 if planes == "byte" else 32) and (unpack(parts, n, planes) == ids).all()
    sink = io.BytesIO()
    writer = Writer(sink, planes, block_ids=64)
    docs = [(i if i != 3 else None, rng.integers(0, 60_000, n, dtype=np.uint32)) for i, n in enumerate([0, 1, 63, 64, 65, 500, 0, 2])]
    for doc_id, ids in docs:
        writer.add(doc_id, ids.tobytes())
    assert writer.close() == len(sink.getvalue())
    reader = Reader(Source(sink.getvalue()))
    got = [(d, np.concatenate([np.zeros(0, np.uint32), *parts])) for d, parts in reader.documents()]
    assert [d for d, _ in got] == [d for d, _ in docs] and all((a == b).all() for (_, a), (_, b) in zip(got, docs, strict=True))
    every = np.concatenate([ids for _, ids in docs])
    assert (reader.block(5) == every[5 * 64 : 6 * 64]).all()
    with pytest.raises(ValueError):
        Reader(Source(sink.getvalue()[:-5]))


def test_ids_are_the_library_s():
    rng = random.Random(2)
    letters = "ab cé  \n\t'sX漢😀.1,;!  \x00<|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["a.\nB", "a,\n\nB", "don't. I'll\nsay", " x", "x ", "a  b", "it's.", "é.\né", "x.y. z", "", "\n", "a\r\nb c"]
    library, encoder = Tokenizer.from_file(PATH), Encoder(PATH)
    for text, ids in zip(texts, encoder.texts([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_corpus(docs, messy, empty):
    library = Tokenizer.from_file(PATH)
    texts = ["b two words", None, "", "x y z " * 50, "漢字\n\nend "] * 4
    rows = docs(texts)
    manifest = write(rows, PATH, output_folder(rows), files=3)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in read(manifest).collect()}
    at = 0
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert got[i] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    manifest = write(messy, PATH, output_folder(messy))
    odd = read(manifest).collect()
    assert len(odd) == 13 and sorted(r.start for r in odd)[0] == 0
    assert sum(r.n_tokens for r in odd) == manifest.groupBy().sum("n_tokens").first()[0]
    assert read(write(empty, PATH, output_folder(empty))).count() == 0
