"""Byte-pair encoding by segment trees, and decoding, with a public tokenizer's vocabulary file.

The pairs of neighbouring symbols of a word are the leaves of a segment tree whose keys order by (rank,
place), so the root is the leftmost merge of the lowest rank. A merge rewrites at most three leaves and
their paths to the root, so a word of n bytes takes O(n log n). Many short words run through their trees
at once as numpy arrays; long words, where a single tree has enough to do, run one by one. Every distinct
word of a worker is encoded once and kept in a bounded memo.

Edge cases
* null and empty texts, and texts of white space only, have no tokens; their decoded text is empty.
* the file's special tokens in a text become their ids, as the library does by default.
* texts with characters outside basic Latin, Latin-1 and Latin Extended-A are normalised and split by the
  library's own normaliser and pre-tokenizer; merging is done here for all texts.
* a word of any length is encoded whole; repeated rows get equal results; an empty table stays empty.
* other columns of the input are ignored by ``digests`` and kept by ``encode``, but for one named ``ids``.
* the memo of words holds a bounded count of them and of their bytes.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from millrace.llm import words

NEVER = int(np.iinfo(np.int64).max)
#: Words with more pairs than this get a tree of their own in plain Python.
WIDE = 128
MEMO_BYTES = 32 << 20
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_NUMBER = "0-9²³¹¼½¾"
#: Characters whose case, composition and class need no tables: white space and Latin without U+0130.
PLAIN = re.compile("[\t-\r -~¡-įı-ſ]*")
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\\s{_LETTER}{_NUMBER}]+|\\s+(?!\\S)|\\s+")


@functools.cache
def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else from U+0100 on."""
    spare = iter(range(256, 512))
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Bpe:
    """The vocabulary, merges, normaliser and splitter of a tokenizer file's JSON."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.source, self.vocab = source, model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.lower = spec.get("normalizer") is not None
        self.pattern = WORDS if self.lower else PIECES
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.inner = np.array([self.vocab[c] for c in byte_alphabet()], np.int64)
        self.last = np.array([self.vocab[c + end] for c in byte_alphabet()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {}
        for rank, (a, b) in enumerate(pairs):
            self.ranks[self.vocab[a] << 16 | self.vocab[b]] = (rank, self.vocab[a + b])
        keys = np.array(sorted(self.ranks), np.int64)
        self.keys = np.append(keys, NEVER)
        self.rank_of = np.array([*(self.ranks[int(k)][0] for k in keys), 0], np.int64)
        self.made = np.zeros(len(pairs), np.int64)
        for rank, new in self.ranks.values():
            self.made[rank] = new
        strings = {i: t for t, i in {**self.vocab, **self.special}.items()}
        self.strings = [strings.get(i, "") for i in range(max(strings) + 1)]

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.source)

    def pieces(self, text: str) -> list[bytes]:
        """The words that merge on their own, as bytes."""
        if PLAIN.fullmatch(text):
            return [p.encode() for p in self.pattern.findall(text.lower() if self.lower else text)]
        back = _bytes_of()
        normal = self.library.normalizer.normalize_str(text) if self.lower else text
        return [bytes(map(back.__getitem__, p)) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def encode_words(self, distinct: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(distinct)
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
        width = np.where(sizes > 1, 2 ** np.ceil(np.log2(np.maximum(sizes - 1, 1))).astype(np.int64), 1)
        for w in np.unique(width[sizes > 0]):
            own = np.flatnonzero((width == w) & (sizes > 0))
            if w > WIDE:
                for i in own:
                    out[i] = self.encode_long(distinct[i]).astype("<u4").tobytes()
                continue
            step = max(1, (1 << 20) // int(w))
            for s in range(0, len(own), step):
                part = own[s : s + step]
                for i, ids in zip(part, self._forest([distinct[i] for i in part], sizes[part], int(w)), strict=True):
                    out[i] = ids
        return out

    def _keys(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        """(rank, place) of pairs as one integer, NEVER where they don't merge."""
        pair = a << 16 | b
        at = np.searchsorted(self.keys, pair)
        return np.where((self.keys[at] == pair) & (b >= 0) & (a >= 0), self.rank_of[at] << 32 | place, NEVER)

    def _forest(self, batch: list[bytes], sizes: np.ndarray, w: int) -> list[bytes]:
        """Words of 2 ** k or fewer pairs, each with its own tree, all merged in step."""
        n = len(batch)
        # Column w + 1 takes writes past a word's end and reads as no symbol.
        sym = np.full((n, w + 3), -1, np.int64)
        flat = np.frombuffer(b"".join(batch), np.uint8)
        row, col = np.repeat(np.arange(n), sizes), words.within(np.zeros(n, np.int64), sizes)
        sym[row, col] = self.inner[flat]
        ends = np.cumsum(sizes) - 1
        sym[np.arange(n), sizes - 1] = self.last[flat[ends]]
        nxt = np.broadcast_to(np.minimum(np.arange(1, w + 4), w + 2), (n, w + 3)).copy()
        prv = np.broadcast_to(np.arange(-1, w + 2), (n, w + 3)).copy()
        tree = np.full((n, 2 * w), NEVER)
        tree[:, w:] = self._keys(sym[:, :w], sym[:, 1 : w + 1], np.arange(w))
        level = w
        while level > 1:
            tree[:, level // 2 : level] = tree[:, level : 2 * level].reshape(n, -1, 2).min(2)
            level //= 2
        root = 1
        r = np.flatnonzero(tree[:, root] != NEVER)
        while len(r):
            top = tree[r, root]
            j = top & 0xFFFFFFFF
            b = nxt[r, j]
            c = nxt[r, b]
            p = prv[r, j]
            new = self.made[top >> 32]
            sym[r, j], sym[r, b] = new, -1
            nxt[r, j] = c
            prv[r, c] = j
            tree[r, w + j] = self._keys(new, sym[r, c], j)
            inside = b < w
            tree[r[inside], w + b[inside]] = NEVER
            before = p >= 0
            rp, pp = r[before], p[before]
            tree[rp, w + pp] = self._keys(sym[rp, pp], new[before], pp)
            for rows, leaves in ((r, j), (r[inside], b[inside]), (rp, pp)):
                node = (w + leaves) >> 1
                for _ in range(w.bit_length() - 1):
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node >>= 1
            r = r[tree[r, root] != NEVER]
        live = sym >= 0
        data, bounds = sym[live].astype("<u4").tobytes(), words.offsets(live.sum(1)) * 4
        return [data[bounds[i] : bounds[i + 1]] for i in range(n)]

    def encode_long(self, word: bytes) -> np.ndarray:
        """One word with one tree, on plain integers: logarithmic work for each merge, some 50 bytes for each byte of the word."""
        n = len(word)
        start = self.inner[np.frombuffer(word, np.uint8)].astype(np.int64)
        start[-1] = self.last[word[-1]]
        w = 1 << max(0, (n - 2).bit_length())
        level = np.full(w, NEVER)
        level[: n - 1] = self._keys(start[:-1], start[1:], np.arange(n - 1))
        whole = np.full(2 * w, NEVER)
        while len(level):
            whole[len(level) : 2 * len(level)] = level
            level = level.reshape(-1, 2).min(1) if len(level) > 1 else level[:0]
        tree, sym, nxt, prv = (array("q", x.tobytes()) for x in (whole, start, np.arange(1, n + 1), np.arange(-1, n - 1)))
        del whole, start, level
        ranks, made = self.ranks, self.made

        def leaf(i: int, k: int) -> int:
            found = ranks.get(sym[i] << 16 | sym[k])
            return NEVER if found is None else found[0] << 32 | i

        def put(i: int, key: int) -> None:
            i += w
            tree[i] = key
            while i > 1:
                i >>= 1
                best = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == best:
                    break
                tree[i] = best

        while (root := tree[1]) != NEVER:
            j = root & 0xFFFFFFFF
            b = nxt[j]
            c = nxt[b]
            sym[j], sym[b], nxt[j] = int(made[root >> 32]), -1, c
            if c < n:
                prv[c] = j
            put(j, leaf(j, c) if c < n else NEVER)
            if b < n - 1:
                put(b, NEVER)
            if prv[j] >= 0:
                put(prv[j], leaf(prv[j], j))
        out = np.frombuffer(sym, np.int64)
        return out[out >= 0]

    @functools.cached_property
    def _blob(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = [s.encode() + b" " for s in self.strings]
        off = words.offsets(map(len, data))
        return np.frombuffer(b"".join(data), np.uint8), off[:-1], np.diff(off)

    def decoded(self, ids: np.ndarray, step: int = 1 << 18) -> Iterator[bytes]:
        """The decoded text's UTF-8 in parts: the file has no decoder, so tokens are joined by spaces."""
        blob, start, size = self._blob
        for s in range(0, len(ids), step):
            part = ids[s : s + step]
            data = blob[words.within(start[part], size[part])].tobytes()
            yield data[:-1] if s + step >= len(ids) else data


@functools.cache
def _bytes_of() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_alphabet())}


class Encoder:
    """A worker's encoder: a Bpe and its memo of distinct words."""

    def __init__(self, source: str, size: int = words.MEMO):
        self.bpe, self.memo, self.size, self.held = Bpe(source), {}, size, 0

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        split, bpe = [], self.bpe
        for t in texts:
            text = t.decode("utf-8", "replace")
            if bpe.cut and any(s in text for s in bpe.special):
                parts = [[p] if p in bpe.special else bpe.pieces(p) for p in bpe.cut.split(text)]
                split.append([x for part in parts for x in part])
            else:
                split.append(bpe.pieces(text))
        if len(self.memo) > self.size or self.held > MEMO_BYTES:
            self.memo.clear()
            self.held = 0
        memo = self.memo
        missing = list({p for ps in split for p in ps if p not in memo})
        self.held += sum(map(len, missing))
        plain = [p for p in missing if isinstance(p, bytes)]
        memo.update(zip(plain, bpe.encode_words(plain), strict=True))
        memo.update((p, np.array([bpe.special[p]], "<u4").tobytes()) for p in missing if isinstance(p, str))
        get = memo.__getitem__
        return [b"".join(map(get, ps)) for ps in split]


def read_vocabulary(path: str | None = None, name: str = "word_bpe_49k.json") -> str:
    """The JSON of a tokenizer file; by default the public one of that name. Read once, on the driver."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, source: str) -> DataFrame:
    """``docs`` with a column ``ids``: array of token ids; a column of that name in the input gives way to it."""
    docs = docs.drop("ids")
    held = docs.sparkSession.sparkContext.broadcast(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(held.value)
        for batch, texts in words.text_batches(batches):
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in encoder.encode(texts)]
            column = pa.ListArray.from_arrays(pa.array(words.offsets(map(len, ids)), pa.int32()), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "ids"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("ids", ArrayType(IntegerType())))


def digests(docs: DataFrame, source: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    held = docs.sparkSession.sparkContext.broadcast(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(held.value)
        for batch, texts in words.text_batches(batches):
            n, first, second = [], [], []
            for ids in encoder.encode(texts):
                n.append(len(ids) // 4)
                first.append(hashlib.sha256(ids).hexdigest())
                text = hashlib.sha256()
                for part in encoder.bpe.decoded(np.frombuffer(ids, "<u4")):
                    text.update(part)
                second.append(text.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
