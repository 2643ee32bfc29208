"""Shared text tools: spans and hashes, pre-tokens against the library, the word model."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from emberlog.llm.arrowtext import ALNUM, NONSPACE, blocks, gram_hashes, span_hashes, spans
from emberlog.llm.tokencache import CachedTokenizer

ODD = ["", " a", "a ", "a  b", "don't  stop\n\n x", "a <|endoftext|> b", "x y z", "é́ e", "　a b", "İstanbul ok", "it's 's 'S x's !'s 'll 'l 'lla 're've 'r", "a\n b", "a \n b", "日本 語 ok", "1 2  3 ¼½ x² 12", "!! ?? 's", "a\x1cb c", "🙂 ok 🙂🙂", "a\u0085b c", "a\x00 b", "X\tY Z\r\n\r\n", "ǅ ǆ ß ẞ", "ÀÉÎ ×÷ «x» ª a'", "'s's 80's\n's '", "\u00ad soft", "  ", "\n", "'", "don'", "x'", "l'lx", "'t", "a'\n't  't", None, "É", "'RE I'LL", "<|startoftext|>"]


@pytest.mark.parametrize(("file", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
@pytest.mark.parametrize("entries", [1_000_000, 5])
def test_ids_are_the_librarys(file, kind, entries):
    own = CachedTokenizer(public_tokenizers.path(file), kind, entries)
    for texts in (ODD, ODD[::-1], ["ab cd's " * 3000 + "end"]):
        got = [ids[b[i] : b[i + 1]].tolist() for _, ids, b in own.encode(pa.array(texts)) for i in range(len(b) - 1)]
        assert got == [own.library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_spans_and_hashes():
    texts = ["Ab cd", None, "", "ab", "é-É x", "cd" * 400_000]
    words = {}
    for first, last, data, offsets in blocks(pa.array(texts)):
        starts, ends, rows = spans(data, offsets, ALNUM)
        for s, e, r, h in zip(starts, ends, rows, span_hashes(data, starts, ends, fold=True), strict=True):
            words.setdefault(first + r, []).append((bytes(data[s:e]), h))
    assert [w for w, _ in words[0]] == [b"Ab", b"cd"] and words[0][0][1] == words[3][0][1] and [w.decode() for w, _ in words[4]] == ["é", "É", "x"] and len(words[5]) == 1
    data, offsets = np.frombuffer(b"a\tb c", np.uint8), np.array([0, 3, 5])
    assert spans(data, offsets, NONSPACE)[2].tolist() == [0, 0, 1]
    hashes = np.arange(10, dtype=np.uint64)
    assert len(gram_hashes(hashes, 11)) == 0 and len(set(gram_hashes(hashes, 3).tolist())) == 8
