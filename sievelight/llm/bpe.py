"""Byte-pair encoding by backtracking, and decoding through an offset table.

One Aho-Corasick pass over a word finds every vocabulary token in it. Tokens are
laid left to right, longest first, each checked against its left neighbour in a
pair-compatibility table: two tokens are compatible when merging their joined
text leaves exactly these two. A dead end backs up to a shorter token, and every
position is abandoned at most once, so the work is linear in the word. A sequence
whose neighbours are all compatible is the one that exact merging gives.

Text is handled as the tokenizer file says: special tokens are cut out first,
the rest is NFC-normalised, white space collapsed, lower-cased character by
character, cut by the file's pattern, and written in the byte alphabet.

Defined cases: null text counts as empty (no ids, decoded text empty); rows with
equal doc_id are all returned; extra columns are ignored; an empty table gives an
empty result; texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

#: Distinct runs of text, their tokens, and token pairs, that a worker remembers before it starts afresh.
CACHE, POOL, PAIRS = 400_000, 8_000_000, 400_000
#: Words that are remembered, and the characters of one; longer ones are rarely met again.
WORDS, KNOWN = 200_000, 64
#: Bytes of text encoded together, a bound on a worker's arrays.
SLICE_BYTES = 1 << 20
#: Characters of a word whose tokens are looked up at once; of a longer word only two such windows are held.
WINDOW = 1 << 16

#: White space as Unicode has it (Python's split also takes U+001C to U+001F).
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ODD = re.compile("[\x1c-\x1f]")

_END = "\0"  # stands for the end-of-word mark while a word is matched


def byte_alphabet() -> list[str]:
    """Printable character for each byte: printable Latin-1 stands for itself, others follow U+0100."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {b: chr(b) for b in printable}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(printable))
    return [table[b] for b in range(256)]


class OffsetTable:
    """Flat buffer of byte strings with offsets; ``join`` concatenates many by id."""

    def __init__(self, pieces: list[bytes]):
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        self.buffer = np.frombuffer(b"".join(pieces), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        return gather(self.buffer, self.offsets, ids)[0].tobytes()


def gather(pool: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """pool[offsets[i]:offsets[i+1]] for each id, concatenated, and each one's length."""
    starts = offsets[ids]
    sizes = offsets[ids + 1] - starts
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)], sizes


class Starts:
    """For each place of a long text the tokens that start there, from short to long, window by window."""

    def __init__(self, codec: Codec, text: str):
        self.codec, self.text, self.held = codec, text, {}

    def __getitem__(self, at: int) -> list[int]:
        window, place = divmod(at, WINDOW)
        if window not in self.held:
            if len(self.held) > 1:  # backing up rarely leaves the window before
                del self.held[max(self.held, key=lambda w: abs(w - window))]
            begin = window * WINDOW
            piece = self.text[begin : begin + WINDOW + self.codec.longest]
            self.held[window] = self.codec.starts_in(piece, WINDOW)
        return self.held[window][place]


class Codec:
    """Encoder and decoder of one tokenizer file (the file's content, as text)."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        mark = model.get("end_of_word_suffix") or ""
        inner = lambda s: s[: -len(mark)] + _END if mark and s.endswith(mark) else s
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        vocab = {inner(t): i for t, i in model["vocab"].items()}
        self.ranks = {(vocab[inner(a)], vocab[inner(b)]): r for r, (a, b) in enumerate(merges)}
        self.made = {}
        for (a, b), r in self.ranks.items():
            self.made.setdefault(vocab[inner(merges[r][0]) + inner(merges[r][1])], (r, a, b))
        self.end = _END if mark else ""
        self.alphabet = {b: c for b, c in enumerate(byte_alphabet())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.newer = _newer_letters()
        self.matcher = ahocorasick.Automaton()
        for token, i in vocab.items():
            self.matcher.add_word(token, i)
        self.matcher.make_automaton()
        names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        size = max(names) + 1
        self.sizes = [0] * size
        for token, i in vocab.items():
            self.sizes[i] = len(token)
        self.longest = max(self.sizes)
        self.chains: dict = {}
        self.compatible: dict = {}
        self.text_table = OffsetTable([(" " + names.get(i, "")).encode() for i in range(size)])
        self.digit_table = OffsetTable([f" {i}".encode() for i in range(size)])
        self.forget()

    def forget(self) -> None:
        """Start the caches afresh."""
        self.pool = array("i")
        self.bounds = array("q", [0])
        self.seen = _Chunks(self)
        self.known: dict[str, list[int]] = {}

    def _chain(self, token: int, side: int) -> list[tuple[int, float, float]]:
        """Pieces on one side of a token's merge tree: (piece, rank that makes it, rank that consumes it)."""
        if (found := self.chains.get((token, side))) is None:
            found, gone, piece = [], float("inf"), token
            while piece in self.made:
                born, *parts = self.made[piece]
                found.append((piece, born, gone))
                gone, piece = born, parts[side]
            found.append((piece, -1, gone))
            self.chains[token, side] = found
        return found

    def fits(self, left: int, right: int) -> bool:
        """True when merging left+right ends as exactly [left, right]."""
        ranks = self.ranks
        for a, born_a, gone_a in self._chain(left, 1):
            for b, born_b, gone_b in self._chain(right, 0):
                rank = ranks.get((a, b))
                if rank is not None and (at := max(rank, born_a, born_b)) < gone_a and at <= gone_b:
                    return False
        return True

    def starts_in(self, text: str, n: int) -> list[list[int]]:
        """Tokens that start at each of the first ``n`` places of ``text``, from short to long."""
        starts: list[list[int]] = [[] for _ in range(n)]
        sizes = self.sizes
        for end, i in self.matcher.iter(text):  # ends ascend
            if (begin := end - sizes[i] + 1) < n:
                starts[begin].append(i)
        return starts

    def encode_word(self, word: str) -> list[int] | array:
        """Token ids of one pre-token."""
        text = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.alphabet) + self.end
        n, sizes, table = len(text), self.sizes, self.compatible
        starts = self.starts_in(text, n) if n <= WINDOW else Starts(self, text)
        dead = bytearray(n + 1)
        # of each token taken: the token, and the choices left to try where it starts
        taken, left = ([], []) if n <= WINDOW else (array("i"), array("i"))
        at, choice, last = 0, len(starts[0]), -1
        while at < n:
            here = starts[at]
            while choice:
                choice -= 1
                i = here[choice]
                to = at + sizes[i]
                if dead[to]:
                    continue
                if last >= 0:
                    key = last << 32 | i
                    ok = table.get(key)
                    if ok is None:
                        if len(table) > PAIRS:
                            table.clear()
                        ok = table[key] = self.fits(last, i)
                    if not ok:
                        continue
                left.append(choice)
                taken.append(i)
                last = i
                at = to
                choice = len(starts[at]) if at < n else 0
                break
            else:
                if not taken:
                    raise ValueError(f"the vocabulary cannot spell {word[:100]!r}")
                dead[at] = 1
                at -= sizes[taken.pop()]
                choice = left.pop()
                last = taken[-1] if taken else -1
        return taken

    def encode_chunk(self, chunk: str) -> list[int]:
        """Token ids of a normalised run of text without white space."""
        shown = chunk if self.newer.isdisjoint(chunk) else "".join("\ue000" if c in self.newer else c for c in chunk)
        out: list[int] = []
        for m in self.words.finditer(shown):
            word = chunk[m.start() : m.end()]
            if (ids := self.known.get(word)) is None:
                ids = self.encode_word(word)  # a list or, of a long word, an array
                if len(word) <= KNOWN:
                    if len(self.known) >= WORDS:
                        self.known.clear()
                    self.known[word] = ids
            out += ids
        return out

    def chunks(self, text: str) -> list[str | tuple[str]]:
        """Runs of normalised text between white space; a special token stands in a tuple, as no text does."""
        out: list[str | tuple[str]] = []
        for part in self.cut.split(text) if self.cut and "<" in text else [text]:
            if part in self.special:
                out.append((part,))
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            part = part.lower()
            if _ODD.search(part):
                out += [x for x in _SPACE.split(part) if x]
            else:
                out += part.split()
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        if len(self.seen) > CACHE or len(self.pool) > POOL:
            self.forget()
        listed = [self.chunks(t) for t in texts]
        sizes = [len(x) for x in listed]
        at = np.fromiter(map(self.seen.__getitem__, chain.from_iterable(listed)), np.int64, sum(sizes))
        ids, lengths = gather(np.array(self.pool, np.int32), np.array(self.bounds, np.int64), at)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *sizes])]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def decode(self, ids: np.ndarray) -> bytes:
        """Tokens joined by a space, as a tokenizer without a decoder joins them."""
        return self.text_table.join(np.asarray(ids, np.int64))[1:]

    def digits(self, ids: np.ndarray) -> bytes:
        return self.digit_table.join(np.asarray(ids, np.int64))[1:]


class _Chunks(dict):
    """Chunk to its place in the pool; a new chunk is encoded on first sight."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, chunk: str | tuple[str]) -> int:
        codec = self.codec
        codec.pool.extend([codec.special[chunk[0]]] if isinstance(chunk, tuple) else codec.encode_chunk(chunk))
        codec.bounds.append(len(codec.pool))
        self[chunk] = at = len(codec.bounds) - 2
        return at


def _newer_letters() -> frozenset[str]:
    """Letters and digits that the pattern library knows but this Python's Unicode
    tables don't yet assign: tokenizers with older tables take them for symbols."""
    every = "".join(map(chr, chain(range(0x80, 0xD800), range(0xE000, 0x110000))))
    return frozenset(c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn")


def encode_documents(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and token_ids) of every whole text.

    ``tokenizer`` is the path of the tokenizer file on the driver; its content
    (a fixed vocabulary of a few MB) is broadcast.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())

    def run(batches):
        codec = Codec(content.value)
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids"] * with_ids
        for batch in batches:
            texts = batch.column(1)
            sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))
            cuts = np.concatenate([[0], np.nonzero(np.diff(np.cumsum(sizes) // SLICE_BYTES))[0] + 1, [len(sizes)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                ids = codec.encode_batch([t or "" for t in texts.slice(a, b - a).to_pylist()])
                columns = [
                    batch.column(0).slice(a, b - a),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(codec.digits(x)).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids], pa.string()),
                ]
                if with_ids:
                    bounds = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(run), schema)
