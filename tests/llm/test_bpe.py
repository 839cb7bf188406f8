import re
import zlib

import numpy as np
import pyarrow as pa
import regex
from helpers import corpus, empty, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from furrow.llm import bpe

LIBRARY = Tokenizer.from_file(bpe.default_tokenizer())


def vocabulary():
    return bpe.Vocabulary.of(bpe.default_tokenizer(), bpe.odd_chars(bpe.default_tokenizer()))


def test_every_code_point_is_split_as_the_library_splits_it():
    v, points = vocabulary(), [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for tail in ("'s", "a 1"):
        wrong = []
        for i in range(0, len(points), 5000):
            text = "\n".join(c + tail for c in points[i:i + 5000])
            want = [text[a:b] for _, (a, b) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)]
            if v.words(text) != want:
                wrong.append(points[i])
        assert not wrong
    alone = [c for c in points[0x500:0x600] + points[0x10900:0x10950] + points[0x323A0:0x323B8]]
    assert all(v.words(c + "'s") == v.library_split(c + "'s") for c in alone)


def library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(
    [" ", "\n", "  ", "'s", "'", "a", "9", "é", "<|endoftext|>", "<|endof", "\x1c", "\x85", " ", "　", "!", "😀", "\t"])).map("".join))
def test_words_are_the_library_s(text):
    v = vocabulary()
    words = v.words(text)
    assert "".join(words) == text
    ids = [i for w in v.encode_words(words) for i in w]
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
    assert b"".join(v.pieces[i] for i in ids).decode("utf-8", "replace") == LIBRARY.decode(ids, skip_special_tokens=False)


def test_encode_decode(spark):
    rows = [*corpus(), (100, "a <|endoftext|> b\r\n\x1c\x1d  ' 's'S", None, None, 1), (101, "é😀" * 2000, None, None, 1)]
    for chars in (bpe.BLOCK_CHARS, 500):
        got = bpe.encode_decode(frame(spark, rows).coalesce(2), bpe.default_tokenizer(), block_chars=chars, stage_input=True).collect()
        found = sorted((r.doc_id is None, r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist(), r.decoded, r.n_tokens) for r in got)
        wanted = sorted((r[0] is None, r[0] or 0, *library(r[1] or ""), len(library(r[1] or "")[0])) for r in rows)
        assert found == wanted


def test_empty(spark):
    assert bpe.encode_decode(empty(spark), bpe.default_tokenizer()).collect() == []


def test_written_out_classes_split_as_the_pattern_does():
    pattern, points = regex.compile(bpe.PATTERN).findall, [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for between in ("", "a", "1", "!", " ", "'s"):
        for i in range(0, len(points), 3000):
            text = between.join(points[i:i + 3000])
            assert bpe.split_words(text) == pattern(text)
    v = vocabulary()
    for i in range(0, len(points), 37):
        text = "".join(points[i:i + 37])
        assert v.odd is None or bool(v.odd(text)) == bool(re.search(f"[{bpe.odd_chars(v.path)}]", text))


def test_blocks_number_words_in_order_of_appearance():
    texts, v = ["b a b", "", "😀 é b", None, "a" * 70000 + " a" * 70000], vocabulary()
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, None, 4, 5], "text": [t or "" for t in texts]})
    for chars in (1, 10, 10 ** 9):
        plain, full = (list(bpe._blocks([batch], v, chars, want)) for want in (False, True))
        assert [(n, w.to_pylist()) for n, w, _ in plain] == [(n, w.to_pylist()) for n, w, _ in full]
        back = []
        for _, words, docs in full:
            words = words.to_pylist()
            numbers = [bpe._widen(zlib.decompress(z), n).tolist() for _, n, z in docs]
            assert words == list(dict.fromkeys(words[i] for ns in numbers for i in ns))
            back += [(d, "".join(words[i] for i in ns)) for (d, _, _), ns in zip(docs, numbers)]
        assert back == list(zip([1, 2, None, 4, 5], [t or "" for t in texts]))
