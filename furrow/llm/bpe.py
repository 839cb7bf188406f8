"""Byte-level BPE encoding and decoding over a distinct-word table.

1. *Blocks.* Each task cuts its documents into blocks of a bounded size, splits
   the texts into words with the tokenizer's own pattern (special tokens
   first) and numbers the distinct words of a block in order of appearance.
   Unicode versions differ on what is a letter. The driver asks the library
   about every code point; a text with one on which our pattern differs is
   split by the library itself, which is slower.
2. *Distinct words.* The words go to the bucket of their hash, packed per
   (block, bucket). A bucket merges the words of all blocks and encodes each
   distinct word once.
3. *Join by position.* The ids return to their block under the words' numbers,
   where the documents wait as sequences of word numbers; every word is
   replaced by its ids, and ids by their pieces through the id-to-piece table
   (the vocabulary: a fixed size) for decoding.

Scale: words travel once per block and distinct word, never per occurrence,
and texts do not travel at all - documents are shuffled as compressed sequences
of word numbers. A frequent word is one row per block; a bucket or block never
holds more than its share of distinct words. The texts are split twice (once
for the words, once for the sequences) instead of being written out.

Defined results: a null text is an empty one and has no ids; repeated rows stay
and count each; a null id stays null; other columns are ignored; an empty table
gives an empty result; bytes that are not UTF-8 after decoding become U+FFFD,
as in the library.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import documents, ship_package, shuffle_partitions, staged, text_or_empty

BLOCK_CHARS = 16_000_000
# The byte-level split pattern, with white space as listed by
# Unicode, since libraries differ on U+001C to U+001F.
_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


@lru_cache(maxsize=1)
def _patterns():
    """PATTERN for ASCII texts, for texts without later planes and for all,
    with the classes of ``regex`` written out for ``re``, which is faster."""
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))

    def written(letters: str, digits: str):
        return re.compile(PATTERN.replace(r"\p{L}\p{N}]", f"{letters}{digits}]").replace(r"\p{L}", f"[{letters}]")
                          .replace(r"\p{N}", f"[{digits}]")).findall

    def ranges(of: str) -> str:
        return "".join(f"\\u{ord(r[0]):04x}-\\u{ord(r[-1]):04x}" for r in regex.findall(f"{of}+", plane))

    return (written("A-Za-z", "0-9"), written(ranges(r"\p{L}"), ranges(r"\p{N}")),
            regex.compile(PATTERN).findall, re.compile("[\U00010000-\U0010ffff]").search)


def split_words(text: str) -> list[str]:
    plain, first_plane, every, beyond = _patterns()
    if text.isascii():
        return plain(text)
    return every(text) if beyond(text) else first_plane(text)


def _search(odd: str):
    """A search for the ranges of ``odd``; those of later planes, which make it
    slow, are looked for only in texts that reach them."""
    if not odd:
        return None
    bounds = [(int(a, 16), int(b, 16)) for a, b in re.findall(r"\\U(\w{8})-\\U(\w{8})", odd)]
    near = "".join(f"\\u{a:04x}-\\u{min(b, 0xFFFF):04x}" for a, b in bounds if a <= 0xFFFF)
    beyond, every = _patterns()[-1], re.compile(f"[{odd}]").search
    first = re.compile(f"[{near}]").search if near else lambda text: None
    return lambda text: every(text) if beyond(text) else first(text)


class Vocabulary:
    """What a task needs of a tokenizer file."""

    _cache: dict[str, Vocabulary] = {}

    def __init__(self, path: str, odd: str = ""):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {**spec["model"]["vocab"], **self.specials}
        to_byte = _byte_of_char()
        self.pieces = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            plain = token in self.specials
            self.pieces[i] = token.encode() if plain else bytes(to_byte[c] for c in token)
        special = "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))
        self.split = split_words
        # A special token can begin inside a run of the pattern, so texts that
        # hold one are cut there first.
        self.cut = regex.compile(f"({special})").split if special else None
        self.odd = _search(odd)
        self.path, self._tokenizer = path, None

    @classmethod
    def of(cls, path: str, odd: str = "") -> Vocabulary:
        if (path, odd) not in cls._cache:
            cls._cache[path, odd] = cls(path, odd)
        return cls._cache[path, odd]

    @property
    def tokenizer(self):
        if self._tokenizer is None:
            from tokenizers import Tokenizer
            self._tokenizer = Tokenizer.from_file(self.path)
            self._tokenizer.no_truncation()
            self._tokenizer.no_padding()
        return self._tokenizer

    def library_split(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def words(self, text: str) -> list[str]:
        split = self.library_split if self.odd and not text.isascii() and self.odd(text) else self.split
        if self.cut and any(s in text for s in self.specials):
            return [w for part in self.cut(text) if part
                    for w in ([part] if part in self.specials else split(part))]
        return split(text)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        out = []
        for i in range(0, len(words), 4096):
            out += [e.ids for e in self.tokenizer.encode_batch_fast(words[i:i + 4096], add_special_tokens=False)]
        return out


@lru_cache(maxsize=4)
def odd_chars(path: str) -> str:
    """The code points that our pattern and the library put in different
    classes, as ranges of a character class. A letter follows a letter without
    a cut, a digit a digit and any other sign another; white space follows none."""
    v = Vocabulary.of(path)
    # later planes hold no letters, digits or spaces in any version
    every = [chr(c) for c in range(0x40000) if not 0xD800 <= c < 0xE000]
    differ = np.zeros(len(every), dtype=bool)
    for before in "a1!":
        for lo in range(0, len(every), 1 << 16):
            text = "".join([before + c for c in every[lo:lo + (1 << 16)]])
            joined = []
            for words in (v.split(text), v.library_split(text)):
                cuts = np.zeros(len(text) + 1, dtype=bool)
                cuts[np.cumsum([len(w) for w in words])] = True
                joined.append(~cuts[1:-1:2])
            differ[lo:lo + (1 << 16)] |= joined[0] != joined[1]
    at = np.array([ord(c) for c in every])[differ]
    if not len(at):
        return ""
    first = np.concatenate([[True], np.diff(at) > 1])
    last = np.concatenate([np.diff(at) > 1, [True]])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(at[first].tolist(), at[last].tolist()))


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves,
    the others, in order, for the characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_WORDS = "bucket int, block string, payload binary"
_BACK = "block string, kind int, payload binary, doc_id bigint, n bigint"


def _blocks(batches, vocabulary: Vocabulary, block_chars: int, want_sequences: bool):
    """Yield (block, distinct words by number, as Arrow strings, [(doc_id, n,
    numbers)]). A block is named by the digest of its words in order, so both
    scans agree on what it holds."""
    chunks, waiting, docs, chars = [], [], [], 0

    def numbered():
        chunks.append(pa.array(waiting, pa.large_string()))
        coded = pa.concat_arrays(chunks).dictionary_encode()
        at, out = 0, []
        if want_sequences:
            numbers = coded.indices.to_numpy().astype("<u4")
            for doc_id, n in docs:
                out.append((doc_id, n, zlib.compress(_narrow(numbers[at:at + n]), 1)))
                at += n
        return _name(coded.dictionary), coded.dictionary, out

    for b in batches:
        for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
            words = vocabulary.words(text)
            waiting += words
            docs.append((doc_id, len(words)))
            if len(waiting) >= 1 << 16:
                chunks.append(pa.array(waiting, pa.large_string()))
                waiting = []
            chars += len(text)
            if chars >= block_chars:
                yield numbered()
                chunks, waiting, docs, chars = [], [], [], 0
    if docs:
        yield numbered()


def _name(words: pa.LargeStringArray) -> str:
    if not len(words):
        return ""
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, dtype="<i8", count=len(words) + 1)
    digest = xxhash.xxh128(ends.tobytes())
    digest.update(memoryview(data)[:int(ends[-1])])
    return digest.hexdigest()


def _narrow(seq: np.ndarray) -> bytes:
    """Low and high halves apart: the high ones are mostly zero."""
    return (seq & 0xFFFF).astype("<u2").tobytes() + (seq >> 16).astype("<u2").tobytes()


def _widen(data: bytes, n: int) -> np.ndarray:
    halves = np.frombuffer(data, dtype="<u2").astype(np.uint32)
    return halves[:n] | (halves[n:] << np.uint32(16))


def _pack_words(words: list[str], numbers: list[int]) -> bytes:
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    head = np.array([len(words)], dtype="<u4").tobytes()
    lengths = np.array([len(w) for w in raw], dtype="<u4").tobytes()
    gaps = np.diff(np.array(numbers, dtype="<u4"), prepend=np.uint32(0)).astype("<u4").tobytes()
    return zlib.compress(head + lengths + gaps + b"".join(raw), 1)


def _unpack_words(payload: bytes) -> tuple[list[str], np.ndarray]:
    data = zlib.decompress(payload)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(data, "<u4", n, 4)).tolist()
    numbers = np.cumsum(np.frombuffer(data, "<u4", n, 4 + 4 * n), dtype=np.uint32)
    raw = data[4 + 8 * n:]
    words = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *ends], ends)]
    return words, numbers


def _send_words(path, odd, buckets, block_chars):
    def run(batches):
        for block, distinct, _ in _blocks(batches, Vocabulary.of(path, odd), block_chars, False):
            parts: dict[int, tuple[list, list]] = {}
            for i, w in enumerate(distinct.to_numpy(zero_copy_only=False).tolist()):
                ws, ns = parts.setdefault(xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) % buckets, ([], []))
                ws.append(w)
                ns.append(i)
            for bucket, (ws, ns) in parts.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket], pa.int32()), pa.array([block], pa.string()),
                     pa.array([_pack_words(ws, ns)], pa.binary())], names=["bucket", "block", "payload"])
    return run


def _back_rows(rows):
    types = [pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                                      names=["block", "kind", "payload", "doc_id", "n"])


def _encode_buckets(path):
    """Encode each distinct word of a bucket once, return ids per block."""
    def run(batches):
        vocabulary, known = Vocabulary.of(path), {}
        bucket = None
        for b in batches:
            for k, block, payload in zip(*(b[c].to_pylist() for c in ("bucket", "block", "payload"))):
                if k != bucket:
                    bucket, known = k, {}
                words, numbers = _unpack_words(payload)
                new = [w for w in words if w not in known]
                for w, ids in zip(new, vocabulary.encode_words(new)):
                    known[w] = np.array(ids, dtype="<u4").tobytes()
                ids = [known[w] for w in words]
                head = np.array([len(words)], dtype="<u4").tobytes()
                lengths = np.array([len(x) // 4 for x in ids], dtype="<u4").tobytes()
                flat = np.frombuffer(b"".join(ids), dtype="<u4")
                data = head + numbers.astype("<u4").tobytes() + lengths + _narrow(flat)
                yield _back_rows([(block, 0, zlib.compress(data, 1), None, None)])
    return run


def _send_sequences(path, odd, block_chars):
    def run(batches):
        for block, _, docs in _blocks(batches, Vocabulary.of(path, odd), block_chars, True):
            for i in range(0, len(docs), 512):
                yield _back_rows([(block, 1, payload, doc_id, n) for doc_id, n, payload in docs[i:i + 512]])
    return run


def _assemble(path):
    """Replace word numbers by ids, ids by pieces."""
    def run(batches):
        pieces = Vocabulary.of(path).pieces
        block, table, out = None, [], []
        start = length = flat = None
        for b in batches:
            for blk, kind, payload, doc_id, n in zip(*(b[c].to_pylist() for c in ("block", "kind", "payload", "doc_id", "n"))):
                if blk != block:
                    block, table, start = blk, [], None
                data = zlib.decompress(payload)
                if kind == 0:
                    k = int(np.frombuffer(data, "<u4", 1)[0])
                    lengths = np.frombuffer(data, "<u4", k, 4 + 4 * k)
                    table.append((np.frombuffer(data, "<u4", k, 4), lengths, _widen(data[4 + 8 * k:], int(lengths.sum()))))
                    continue
                if start is None:
                    start, length, flat = _table(table)
                    table = []
                if n and not len(start):
                    raise ValueError("the documents came in another order when read again: pass stage_input=True")
                seq = _widen(data, n)
                ln = length[seq]
                ends = np.cumsum(ln)
                total = int(ends[-1]) if n else 0
                at = np.repeat(start[seq] - (ends - ln), ln) + np.arange(total)
                ids = flat[at]
                text = b"".join([pieces[i] for i in ids.tolist()]).decode("utf-8", "replace")
                out.append((doc_id, total, ids.astype("<u4").tobytes(), text))
                if len(out) >= 256:
                    yield _result(out)
                    out = []
        if out:
            yield _result(out)
    return run


def _table(parts):
    """One table of a block: for each word number, where its ids are."""
    if not parts:
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(0, dtype=np.uint32)
    numbers = np.concatenate([p[0] for p in parts])
    lengths = np.concatenate([p[1] for p in parts]).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    start, length = np.empty(len(numbers), dtype=np.int64), np.empty(len(numbers), dtype=np.int64)
    start[numbers], length[numbers] = starts, lengths
    return start, length, np.concatenate([p[2] for p in parts])


_OUT = "doc_id bigint, n_tokens bigint, ids binary, decoded string"


def _result(out):
    types = [pa.int64(), pa.int64(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)],
                                      names=["doc_id", "n_tokens", "ids", "decoded"])


def encode_decode(docs: DataFrame, tokenizer: str, block_chars: int = BLOCK_CHARS,
                  stage_input: bool = False) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, decoded) for all rows of ``docs``; ``ids``
    are little-endian unsigned 32-bit integers.

    ``docs`` is read twice and must come in the same order both times, as a
    table scan does. Otherwise (say, after a shuffle) set ``stage_input``."""
    ship_package(docs.sparkSession)
    if stage_input:
        docs = staged(docs.select("doc_id", "text"), "bpe-input")
    buckets, odd = shuffle_partitions(docs), odd_chars(tokenizer)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    words = texts.mapInArrow(_send_words(tokenizer, odd, buckets, block_chars), _WORDS)
    table = words.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(
        _encode_buckets(tokenizer), _BACK)
    sequences = texts.mapInArrow(_send_sequences(tokenizer, odd, block_chars), _BACK)
    joined = table.unionByName(sequences).repartition(buckets, "block").sortWithinPartitions("block", "kind")
    return joined.mapInArrow(_assemble(tokenizer), _OUT)


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    done = encode_decode(documents(spark, sf_dir), default_tokenizer())
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op4_bpe": op4_bpe}
