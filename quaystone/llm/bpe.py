"""BPE encoding and decoding as bounded-lookahead streaming transducers.

`Transducer` reads a word's symbols from left to right and emits a token as soon as
no later symbol can change it. How far it must look ahead is a property of the merge
list, computed once by `sufficient_lookahead`: symbols beyond the end of the buffer
can only matter through a chain of merges of growing rank, each of which takes the
left neighbour of the one before, so the longest such chain, in symbols, bounds how
far left of the buffer's end a token may still change. A buffer is a little over twice
that; words that end before it is full (1,399 bytes with the default file) are merged as a
whole. Texts are read in pieces of `PIECE` characters, cut before white space or, where a long
stretch has none, at the next place that nothing spans: between words of any kind, at
added tokens, or inside a run of letters or of marks. A word that goes on in the next piece
goes on in the same transducer. So `Encoder.stream` holds one piece and one buffer, with
one exception: a run of combining marks has no such place, as normalisation may move its
last one to its front, and is held whole. Rows hold a text and all its ids (`encode`).

`Decoder` is the way back: it takes ids in any portions and gives the text that is
complete so far. Byte-level files go through an incremental UTF-8 decoder; files
without a decoder join their tokens' strings with blanks.

Words seen before are looked up (a bounded table); that changes no result.

Defined results
    null text: as the empty text, no ids and an empty decoded text. Unpaired
    surrogates cannot occur in Spark strings. Repeated rows give equal results.
    Empty table: empty result. Other columns are ignored. Unknown ids in decoding
    are skipped.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 16  # characters of a text handled at once
KNOWN_WORDS = 120_000  # words looked up instead of encoded again (some 30 MB)
KNOWN_LENGTH = 48
BATCH_BYTES = 8 << 20
_NONE = 1 << 62


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], width: dict[str, int]) -> int:
    """Symbols to the left of the buffer's end within which tokens may still change.

    Going through the merges from the last to the first, ``reach[t]`` is how far left
    of a token ``t`` whose presence is in doubt the doubt can spread by later merges.
    A merge (u, v) passes doubt about v, or about any token that v may grow from on
    its left edge, on to u.
    """
    parts = {u + v: u for u, v in merges}
    reach: dict[str, int] = {}
    most = 1
    for u, v in reversed(merges):
        far = width[u] + reach.get(u, 0)
        most = max(most, far)
        while v is not None:
            if reach.get(v, 0) < far:
                reach[v] = far
            v = parts.get(v)
    return most


class Transducer:
    """Encodes words given as symbol ids by a `Run` each; see the module's text."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        made = {u + v: rank for rank, (u, v) in enumerate(merges)}
        if len(made) < len(merges) or any(made.get(part, -1) >= rank for rank, pair in enumerate(merges) for part in pair):
            raise ValueError("merges are not in the order in which their parts are made")
        self.width: dict[str, int] = {}
        for t in vocabulary:
            self.width[t] = max(1, len(t) - (len(suffix) if suffix and t.endswith(suffix) else 0))
        self.lookahead = sufficient_lookahead(merges, self.width)
        # A pair of ids as one number, and its rank before the id it makes: the least is merged first.
        self.pairs = {vocabulary[u] << 32 | vocabulary[v]: r << 32 | vocabulary[u + v] for r, (u, v) in enumerate(merges)}
        self.width_of = {i: self.width[t] for t, i in vocabulary.items()}
        self.room = 2 * self.lookahead + 64

    def merged(self, ids: list[int]) -> list[int]:
        """All merges within ``ids``, lowest rank first, leftmost first."""
        if len(ids) > 40:
            return self._merged_long(ids)
        get, ids = self.pairs.get, [*ids]
        ranks = [get(u << 32 | v, _NONE) for u, v in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            k, new = ranks.index(best), best & 0xFFFFFFFF
            ids[k] = new
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = get(ids[k - 1] << 32 | new, _NONE)
            if k < len(ranks):
                ranks[k] = get(new << 32 | ids[k + 1], _NONE)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs and links between what is left."""
        ids, n, get = [*ids], len(ids), self.pairs.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := get(ids[k] << 32 | ids[k + 1], _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            best, k, u, v = heapq.heappop(heap)
            j = after[k]
            if ids[k] != u or j < 0 or ids[j] != v:
                continue
            ids[k], ids[j], after[k] = best & 0xFFFFFFFF, -1, after[j]
            if after[k] >= 0:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (r := get(ids[x] << 32 | ids[y], _NONE)) != _NONE:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def start(self) -> Run:
        return Run(self)


class Run:
    """One word on its way through a `Transducer`: tokens come out as soon as they are stable."""

    def __init__(self, transducer: Transducer):
        self.transducer, self.buffer = transducer, []

    def push(self, symbols: list[int]) -> Iterator[int]:
        """The tokens that nothing after ``symbols`` can change."""
        t, at = self.transducer, 0
        while at < len(symbols):
            take = t.room - len(self.buffer)
            self.buffer += symbols[at : at + take]
            at += take
            if len(self.buffer) >= t.room:
                stable, done, emitted = len(self.buffer) - t.lookahead, 0, 0
                tokens = t.merged(self.buffer)
                for token in tokens:
                    if done + t.width_of[token] > stable:
                        break
                    done += t.width_of[token]
                    emitted += 1
                yield from tokens[:emitted]
                del self.buffer[:done]

    def finish(self, last: int) -> list[int]:
        """The rest, ``last`` being the word's final symbol."""
        return self.transducer.merged([*self.buffer, last])


class _Known(dict):
    """Ids of words as bytes, made when first asked for; bounded."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        ids = self.encoder.word(word)
        if len(word) <= KNOWN_LENGTH and len(self) < KNOWN_WORDS:
            self[word] = ids  # frequent words come early
        return ids


#: Letters and digits of these ranges (lower case, one case pair each) let the faster
#: pattern below split exactly as the file's own one does.
_PLAIN = re.compile("[^\\x00-\\x1b\\x20-\\x7fß-öø-ÿ]")
_PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \\t\\n\\r\\x0b\\x0ca-z0-9ß-öø-ÿ]+")
_FILE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BREAK = re.compile(r"[ \t\n\r]")


def _starts(c: str) -> bool:
    """Whether nothing before ``c`` can be composed with it, or change places with it, in normalisation."""
    return c < "\u0300" or not (unicodedata.category(c)[0] == "M" or "\u1160" <= c <= "\u11ff" or unicodedata.combining(c))


def lower(text: str) -> str:
    """Lower case character by character (no rule looks at neighbours)."""
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


class Encoder:
    """Texts to ids with a ``tokenizers`` file of normalised, split words."""

    def __init__(self, content: str):
        file = json.loads(content)
        model, normalizers = file["model"], (file["normalizer"] or {}).get("normalizers", [])
        if [n["type"] for n in normalizers] != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or model["byte_fallback"] or model["continuing_subword_prefix"]:
            raise ValueError("this layout of a tokenizer file is not known")
        split = file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.plain = split == _FILE_WORDS
        self.words = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.space = regex.compile(r"\p{White_Space}+")
        added = {a["content"]: a["id"] for a in file["added_tokens"]}
        self.added = {t: np.uint32(i).tobytes() for t, i in added.items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.transducer = Transducer(vocabulary, merges, suffix)
        self.inner = [vocabulary[c] for c in byte_characters()]
        self.final = [vocabulary[c + suffix] for c in byte_characters()]
        self.known = _Known(self)
        names = {i: t for t, i in chain(vocabulary.items(), added.items())}
        self.names = [names.get(i) for i in range(max(names) + 1)]
        self.byte_level = (file["decoder"] or {}).get("type") == "ByteLevel"

    def word(self, word: str) -> bytes:
        data, run = word.encode(), self.transducer.start()
        tokens = [*run.push([self.inner[b] for b in data[:-1]])]
        return array("I", tokens + run.finish(self.final[data[-1]])).tobytes()

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """``text`` in parts, and whether a part ends inside a word.

        Parts end before white space; where the next ``PIECE`` characters have none, at the first
        place that no normalisation, no match of the words' pattern and no added token spans.
        """
        at = 0
        while len(text) - at > PIECE:
            blank = _BREAK.search(text, at + PIECE, at + 2 * PIECE)
            if blank:
                cut, inside = blank.start(), False
            else:
                cut, inside = next(((k, i) for k in range(at + PIECE, len(text)) if (i := self.between(text, k)) is not None), (None, False))
            if cut is None:
                break
            yield text[at:cut], inside
            at = cut
        yield text[at:] if at else text, False

    def kind(self, c: str) -> str:
        """What the words' pattern takes a normalised character for: space, letter, number or other."""
        return " " if self.space.fullmatch(c) else found if (found := unicodedata.category(c)[0]) in "LN" else "O"

    def between(self, text: str, k: int) -> bool | None:
        """Whether a cut at ``k`` parts a word; null where there can be none.

        Neither side's normal form may depend on the other's, no added token may lie across, and
        a word that is parted has to be one whose rest is read as one word by itself.
        """
        if not _starts(text[k]) or any(text.startswith(t, k - n) for t in self.added for n in range(1, min(len(t), k + 1))):
            return None
        if any(text.startswith(t, k) or text.endswith(t, 0, k) for t in self.added):
            return False
        if not self.plain:
            return False if self.space.fullmatch(text[k]) else None
        begin, end = max(0, k - 40), min(len(text), k + 40)
        while begin and begin < k and not _starts(text[begin]):
            begin += 1
        while end < len(text) and end > k + 1 and not _starts(text[end]):
            end -= 1
        left, right = (lower(unicodedata.normalize("NFC", x)) for x in (text[begin:k], text[k:end]))
        if not left or not right:
            return None
        a, b = self.kind(left[-1]), self.kind(right[0])
        if " " in (a, b) or "N" in (a, b) or (a, b) == ("L", "O"):
            return False
        if (a, b) == ("O", "L"):
            return None if left[-1] == "'" else False  # the apostrophe may begin "'s"
        if a == "L":  # four letters before: they are no "'re" that goes on
            return True if len(left) > 3 and all(self.kind(c) == "L" for c in left[-4:]) else None
        return True if right[0] != "'" or (len(right) > 1 and self.kind(right[1]) == "O") else None

    def stream(self, text: str) -> Iterator[bytes]:
        """The ids of ``text`` as bytes (little-endian, 32 bits each), portion by portion."""
        run, held = None, b""  # a word that began in the piece before, and its last byte
        for piece, inside in self.pieces(text):
            parts = self.special.split(piece) if self.special and any(t in piece for t in self.added) else [piece]
            for n, part in enumerate(parts):
                if part in self.added:
                    yield self.added[part]
                    continue
                words = self.words_of(part) if part else []
                if run and n == 0:
                    data = held + (words.pop(0).encode() if words else b"")
                    yield array("I", [*run.push([self.inner[b] for b in data[:-1]])]).tobytes()
                    held = data[-1:]
                    if not (inside and len(parts) == 1 and not words):  # the word ends here
                        yield array("I", run.finish(self.final[held[0]])).tobytes()
                        run = None
                if inside and n == len(parts) - 1 and words:
                    data, run = words.pop().encode(), self.transducer.start()
                    last = array("I", [*run.push([self.inner[b] for b in data[:-1]])]).tobytes()
                    yield b"".join(map(self.known.__getitem__, words))
                    yield last
                    held = data[-1:]
                else:
                    yield b"".join(map(self.known.__getitem__, words))

    def words_of(self, part: str) -> list[str]:
        if not part.isascii() and not unicodedata.is_normalized("NFC", part):
            part = unicodedata.normalize("NFC", part)
        low = lower(part)
        if self.plain and not _PLAIN.search(low):
            return _PLAIN_WORDS.findall(low)
        return self.words.findall(lower(self.space.sub(" ", part)))

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.stream(text or ""))


class Decoder:
    """Ids to text, in portions: `push` returns the text that is complete, `finish` the rest."""

    def __init__(self, encoder: Encoder):
        self.names, self.begun = encoder.names, False
        self.bytes = {c: b for b, c in enumerate(byte_characters())} if encoder.byte_level else None
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: np.ndarray) -> str:
        n, names = len(self.names), self.names
        tokens = [names[i] for i in ids.tolist() if i < n and names[i] is not None]
        if self.bytes is not None:
            known = self.bytes
            data = b"".join(bytes([known[c]]) if c in known else c.encode() for t in tokens for c in t)
            return self.utf8.decode(data)
        lead = " " if self.begun and tokens else ""
        self.begun = self.begun or bool(tokens)
        return lead + " ".join(tokens)

    def finish(self) -> str:
        return self.utf8.decode(b"", final=True)


def decode(encoder: Encoder, ids: bytes, portion: int = 1 << 16) -> str:
    decoder, array = Decoder(encoder), np.frombuffer(ids, np.uint32)
    return "".join([decoder.push(array[i : i + portion]) for i in range(0, len(array), portion)] + [decoder.finish()])


@lru_cache(2)
def encoder_for(content: str) -> Encoder:
    return Encoder(content)


def _shared_file(docs: DataFrame, path: str | None):
    """The vocabulary's content for all executors (a file of a few MB, read by the driver)."""
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
_DECODED = pa.schema([*_IDS, ("text", pa.string())])


def _encode(encoder: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, made, size = [], [], 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            keys.append(key)
            made.append(encoder.encode(text.as_py()))
            size += len(made[-1])
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(made, pa.binary())], schema=_IDS)
                keys, made, size = [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(made, pa.binary())], schema=_IDS)


def _decode(encoder: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        begin, size, texts = 0, 0, []
        for k, ids in enumerate(batch.column(1)):
            texts.append(decode(encoder, ids.as_py() or b""))
            size += 2 * len(texts[-1])
            if size > BATCH_BYTES or k == batch.num_rows - 1:
                part = batch.slice(begin, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], schema=_DECODED)
                begin, size, texts = k + 1, 0, []


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids`` for each row of ``docs(doc_id, text)``; ids are little-endian 32-bit numbers."""
    content = _shared_file(docs, path)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda batches: _encode(encoder_for(content.value), batches), "doc_id bigint, ids binary")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids, text`` for each row of ``encoded(doc_id, ids)``."""
    content = _shared_file(encoded, path)
    return encoded.select("doc_id", "ids").mapInArrow(lambda batches: _decode(encoder_for(content.value), batches), "doc_id bigint, ids binary, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """`decode_documents` of `encode_documents`, in one Python step.

    As two steps a task would keep two workers, each with the whole vocabulary, and
    workers stay with their executor for all that follows.
    """
    content = _shared_file(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(content.value)
        return _decode(encoder, _encode(encoder, batches))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, ids binary, text string")
