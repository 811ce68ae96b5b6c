import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from weft.llm.pieces import Codec, Model, decode, encode

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec():
    return Codec(Model(PATH))


def samples(pieces):
    rng = random.Random(1)
    letters = "abcdefghi  \n\t<s>éß漢字😀▁'’.,0123ABC…ﬁ aeiou theing"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    out += ["", " ", "  ", "\n", "\nA", "a\nB", "a \nB", "a\n B", "a", "aaaaaaaaaaaaaaaaaaa", " a  b ", "x" * 400, "<s> </s> <unk> <0x41>"]
    out += ["".join(rng.choice(letters.replace(" ", "")) for _ in range(n)) for n in (513, 900, 2000)] + ["".join(rng.choices(pieces, k=300)).replace("▁", "")]
    return out + [(p + rng.choice(pieces) + rng.choice(pieces)).replace("▁", " ") for p in rng.sample(pieces, 2500)]


def test_ids_are_the_library_s_and_decode(codec):
    library = SentencePieceProcessor(model_file=PATH)
    texts = samples(codec.model.pieces)
    got = codec.encode([t.encode() for t in texts])
    assert [g.tolist() for g in got] == library.encode(texts)
    for text, back in zip(texts, codec.decode(got), strict=True):
        assert back.decode() == text.replace("▁", " ")


def test_counts_are_those_of_the_ids(codec):
    texts = [t.encode() for t in samples(codec.model.pieces)] + [None]
    assert codec.count(texts) == [len(x) for x in codec.encode(texts)]


def test_long_words_take_the_same_way(codec):
    library, rng = SentencePieceProcessor(model_file=PATH), random.Random(7)
    words = ["".join(rng.choice("abcdeфé漢😀") for _ in range(n)) for n in (5, 5, 800, 800, 5000)]
    assert [x.tolist() for x in codec.model.segment(["▁" + w for w in words])] == library.encode(words)


def test_pairs_are_those_of_merging(codec):
    import numpy as np

    library, model, rng = SentencePieceProcessor(model_file=PATH), codec.model, random.Random(4)
    inner = [i for i, p in enumerate(model.pieces) if "▁" not in p]
    pairs = [(rng.choice(inner), rng.choice(inner)) for _ in range(3000)]
    got = model.compatible(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    for (a, b), stays in zip(pairs, got, strict=True):
        # a control character, unknown to the model, keeps the dummy space away
        ids = library.encode("\x01" + model.pieces[a] + model.pieces[b])
        want = ids[-2:] == [model.ids[a], model.ids[b]] and len(ids) == len(library.encode("\x01")) + 2
        assert stays == want


def test_table(docs, messy, empty):
    library = SentencePieceProcessor(model_file=PATH)
    texts = ["some text here", None, "", "two  spaces", "漢字 😀"]
    rows = encode(docs(texts), PATH)
    got = {r.doc_id: r for r in rows.collect()}
    assert [got[i].ids for i in range(5)] == [library.encode(t or "") for t in texts]
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in got.values())
    assert {r.doc_id: r.text for r in decode(rows, PATH).collect()} == {i: t or "" for i, t in enumerate(texts)}
    odd = encode(messy, PATH, with_ids=False).collect()
    assert len(odd) == 13 and all(r.round_trip for r in odd)
    assert encode(empty, PATH).count() == 0
