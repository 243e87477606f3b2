"""Operator 1: SentencePiece encoding and decoding by a streaming Viterbi search.

Nodes are boundaries between characters. A boundary keeps one backpointer: the last piece of the best segmentation of
everything before it. For unigram models the best one has the largest sum of scores; for merge (BPE) models it is the
segmentation that merging gives, which is found locally: a segmentation is that of merging exactly if every pair of
neighbours, merged alone, gives this pair again, so that exactly one piece that ends at a boundary fits the backpointer
where it begins. A later piece can only begin at one of the last ``longest`` boundaries; whenever all backpointer paths
from these meet in one boundary, the ids before it are committed and forgotten. Memory is thus bounded by the window,
whatever the length of the text.

In models none of whose pieces has a blank after another character, all paths meet before every blank that follows such a
character; there the text is cut, and a memo keeps the ids of the words met before.

Characters that no piece covers become their UTF-8 bytes (byte fallback), or the unknown id in models without bytes.

Defined cases: null and empty texts have no ids and decode to the empty text; texts of any length; a literal U+2581 decodes to
a blank, as in the library; unknown ids decode to nothing; repeated rows are encoded each; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Memo, WordTable, arrow_map, documents, gathered

BLANK = "▁"
#: Words up to 64 characters are remembered.
LONG = re.compile("[^ ]{65}")


def kind_of(model: bytes) -> str:
    """"unigram" or "bpe": field 3 of the training settings (field 2 of a model), 1 where it isn't written."""

    def fields(data: bytes):
        at = 0

        def number() -> int:
            nonlocal at
            value = shift = 0
            while True:
                b = data[at]
                at, value, shift = at + 1, value | (b & 127) << shift, shift + 7
                if b < 128:
                    return value

        while at < len(data):
            key = number()
            if key & 7 == 0:
                yield key >> 3, number()
            else:
                n = number() if key & 7 == 2 else 8 if key & 7 == 1 else 4
                yield key >> 3, data[at : at + n]
                at += n

    settings = next((x for k, x in fields(model) if k == 2), b"")
    kind = next((x for k, x in fields(settings) if k == 3), 1)
    if kind not in (1, 2):
        raise ValueError("only unigram and merge (BPE) models are known")
    return "unigram" if kind == 1 else "bpe"


class Pieces:
    """The pieces of a model file, by number; characters that are no piece get numbers as they are met."""

    def __init__(self, path: str, kind: str | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = kind or kind_of(model.serialized_model_proto())
        every = range(model.get_piece_size())
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in every if model.is_byte(i)}
        self.unknown, self.kind = model.unk_id(), kind
        self.raw = [b"" if model.is_control(i) or model.is_unknown(i) else model.id_to_piece(i).replace(BLANK, " ").encode() for i in every]
        for value, i in self.byte.items():
            self.raw[i] = bytes((value,))
        plain = [i for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        self.text = [model.id_to_piece(i) for i in plain]
        self.score = [model.get_score(i) for i in plain]
        self.ids = [[i] for i in plain]
        self.number = {t: k for k, t in enumerate(self.text)}
        self.longest = max(map(len, self.text))
        self.inner_blanks = any(re.search(f"[^{BLANK}]{BLANK}", t) for t in self.text)
        self.penalty = min(self.score, default=0.0) - 10
        # by the last four characters before a boundary: the lengths of the pieces that may end there, longest first
        ends: dict[str, set[int]] = {}
        for t in self.text:
            ends.setdefault(t[-4:], set()).add(len(t))
        self.lengths = Memo(lambda e: tuple(sorted({n for k in range(len(e)) for n in ends.get(e[k:], ()) if k == 0 or n == len(e) - k}, reverse=True)))
        # order of merges: 0 for single characters, then by falling score
        levels = {x: k + 1 for k, x in enumerate(sorted(set(self.score), reverse=True))}
        self.order = [levels[x] if len(t) > 1 else 0 for t, x in zip(self.text, self.score)]
        shared = {x for x, times in Counter(self.score).items() if times > 1}
        self.tied = [len(t) > 1 and x in shared for t, x in zip(self.text, self.score)]
        self._parts = Memo(self._split)
        self._pair = Memo(lambda key: self._stay_apart(key >> 32, key & 0xFFFFFFFF), 400_000)

    def character(self, c: str) -> int:
        """The number of a character that is no piece."""
        k = self.number[c] = len(self.text)
        self.text.append(c)
        self.score.append(self.penalty)
        self.order.append(0)
        self.tied.append(False)
        self.ids.append([self.byte[b] for b in c.encode()] if self.byte else [self.unknown])
        return k

    def merged(self, text: str) -> list[str]:
        """Merging as defined: again and again the leftmost of the best-scored neighbours."""
        return self._merge(list(text))[0]

    def _merge(self, parts: list[str]) -> tuple[list[str], list[tuple[str, str]]]:
        done = []
        while True:
            best = max(((self.score[self.number[a + b]], -k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.number), default=None)
            if best is None:
                return parts, done
            k = -best[1]
            done.append((parts[k], parts[k + 1]))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _split(self, k: int) -> tuple[int, int] | None | bool:
        """The two pieces of which merging makes this one; None for a character; False if it never makes it; True if its
        steps aren't in falling score, so that only merging itself can tell what happens beside it."""
        t = self.text[k]
        if len(t) == 1:
            return None
        parts, done = self._merge(list(t))
        if parts != [t]:
            return False
        left, right = (self.number[x] for x in done[-1])
        inner = [self._parts[x] for x in (left, right)]
        if self.tied[k] or any(x is True or x is False for x in inner) or max(self.order[left], self.order[right]) >= self.order[k]:
            return True
        return left, right

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether no merge crosses from piece ``a`` into its right neighbour ``b``: going back in time, no two parts that
        meet at the border could have merged before one of them grew."""
        if self._parts[a] is True or self._parts[b] is True:
            return self.merged(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]
        order, text, limit = self.order, self.text, 1 << 60
        while True:
            whole = self.number.get(text[a] + text[b])
            if whole is not None and order[whole] < limit:
                return False
            if order[a] > order[b]:
                limit, a = order[a], self._parts[a][1]
            elif order[b]:
                limit, b = order[b] + 1, self._parts[b][0]
            else:
                return True

    def _extend(self, text: str, at: int, to: int, base: int, last: list[int], total: list[float]) -> None:
        """The backpointers of the boundaries after ``at`` up to ``to``; last[k]: number of the last piece before base + k."""
        number, parts, pair, lengths = self.number, self._parts, self._pair, self.lengths
        if self.kind == "bpe":
            for at in range(at + 1, to + 1):
                for n in lengths[text[at - 4 if at > 4 else 0 : at]]:
                    if n <= at - base and (k := number.get(text[at - n : at])) is not None and parts[k] is not False:
                        before = last[at - n - base]
                        if before < 0 or pair[before << 32 | k]:
                            last.append(k)
                            break
                else:
                    c = text[at - 1]
                    last.append(number[c] if c in number else self.character(c))
            return
        for at in range(at + 1, to + 1):
            best, c = None, text[at - 1]
            for n in range(min(self.longest, at - base), 0, -1):
                k = number.get(text[at - n : at]) if n > 1 or c in number else self.character(c)
                if k is not None and (best is None or total[at - n - base] + self.score[k] > best[0]):
                    best = (total[at - n - base] + self.score[k], k)
            total.append(best[0])
            last.append(best[1])

    def stream(self, text: str) -> Iterator[int]:
        """The ids of a text, committed as early as they are certain."""
        base, at, last, total = 0, 0, [-1], [0.0]
        while True:
            to = min(at + max(4 * self.longest, at - base), len(text))  # paths that stay apart are looked at again when the window has doubled
            self._extend(text, at, to, base, last, total)
            at = to
            if at == len(text):
                yield from self.path(last, len(last) - 1)
                return
            meet = self.meeting(last)
            yield from self.path(last, meet)
            base += meet
            del last[:meet], total[:meet]

    def many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of words that stand after a blank: one array, and where each word's begin and how many they are. In order, so
        that a word goes on from the boundaries that it shares with the one before."""
        order = sorted(range(len(words)), key=words.__getitem__)
        flat: list[int] = []
        starts = []
        old, last, total = "", [-1], [0.0]
        for at in range(0, len(order), 50_000):
            ordered = [BLANK + words[k] for k in order[at : at + 50_000]]
            letters = np.array([old, *ordered])
            letters = letters.view(np.uint32).reshape(len(letters), -1)
            shared = (letters[1:] == letters[:-1]).argmin(axis=1).tolist()  # characters that a word shares with the one before
            for word, same in zip(ordered, shared):
                same = min(same, len(old))
                del last[same + 1 :], total[same + 1 :]
                self._extend(word, same, len(word), 0, last, total)
                starts.append(len(flat))
                flat += self.path(last, len(word))
                old = word
        of = np.empty((2, len(words)), np.int64)
        of[:, order] = starts, np.diff([*starts, len(flat)])
        return np.array(flat, "<i4"), *of

    def meeting(self, last: list[int]) -> int:
        """The boundary through which all paths lead that a later piece can continue."""
        ends = set(range(max(len(last) - self.longest, 0), len(last)))
        while len(ends) > 1:
            k = max(ends)
            ends.remove(k)
            ends.add(k - len(self.text[last[k]]))
        return ends.pop()

    def path(self, last: list[int], to: int) -> list[int]:
        out, text, ids = [], self.text, self.ids
        while to > 0:
            k = last[to]
            out.append(k)
            to -= len(text[k])
        return [i for k in reversed(out) for i in ids[k]]


@lru_cache(2)
def pieces_of(path: str, kind: str | None = None) -> Pieces:
    """The pieces of a model, one object a worker, so that what it has worked out serves later tasks too."""
    return Pieces(path, kind)


@lru_cache(2)
def encoder(pieces: Pieces):
    """A function from texts to their ids: one array for all, and the texts' ends in it."""
    cut = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")

    def whole(text: str) -> np.ndarray:
        """The ids of a text as it comes, with a blank before it."""
        parts = [BLANK + text.replace(" ", BLANK)] if pieces.inner_blanks else cut.findall(BLANK + text.replace(" ", BLANK))
        return np.fromiter((i for w in parts if text for i in pieces.stream(w)), "<i4")

    words = WordTable(pieces.many, "<i4", 600_000)

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # single blanks part words; runs of blanks and words too long to be remembered are for the window alone
        apart = {k: whole(t) for k, t in enumerate(texts) if pieces.inner_blanks or not t or t[0] == " " or t[-1] == " " or "  " in t or BLANK in t or LONG.search(t)}
        plain = [t for k, t in enumerate(texts) if k not in apart]
        flat, ends = words.texts(pa.array(plain, pa.string())) if plain else (np.empty(0, "<i4"), [0])
        if not apart:
            return flat, ends
        at = iter(zip(ends, ends[1:]))
        parts = [apart[k] if k in apart else flat[slice(*next(at))] for k in range(len(texts))]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    return encode


@lru_cache(2)
def decoder(pieces: Pieces):
    """A function from ids, as one array with the texts' ends in it, to the texts."""
    raw = [*pieces.raw, b""]  # unknown ids decode to nothing
    flat = np.frombuffer(b"".join(raw), np.uint8)
    lengths = np.array([len(x) for x in raw], np.int64)
    starts = np.cumsum(lengths) - lengths

    def decode(ids: np.ndarray, ends: np.ndarray) -> list[str]:
        ids = np.where((ids >= 0) & (ids < len(raw)), ids, len(raw) - 1)
        at = np.concatenate([[0], np.cumsum(lengths[ids])])[ends].tolist()
        data = gathered(flat, starts[ids], lengths[ids]).tobytes()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]
        return [t[1:] if t[:1] == " " else t for t in texts]

    return decode


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def id_lists(ids: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, path: str | None = None, kind: str | None = None) -> DataFrame:
    """doc_id and ids of every row (doc_id, text)."""

    def make():
        to_ids = encoder(pieces_of(path or model_path(), kind))

        def step(doc_id, text):
            return {"doc_id": pa.array(doc_id, pa.int64()), "ids": id_lists(*to_ids([t or "" for t in text]))}

        return step

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of every row (doc_id, ids)."""

    def make():
        to_text = decoder(pieces_of(path or model_path()))

        def step(doc_id, ids):
            ids = [[-1 if i is None else i for i in x or ()] for x in ids]
            texts = to_text(np.array([i for x in ids for i in x], np.int64), np.cumsum([0, *map(len, ids)]))
            return {"doc_id": pa.array(doc_id, pa.int64()), "text": pa.array(texts, pa.string())}

        return step

    return arrow_map(encoded.select("doc_id", "ids"), make, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids, ids_crc32, decoded_sha256, and whether decoding gives the text again."""

    def make():
        pieces = pieces_of(path or model_path())
        to_ids, to_text = encoder(pieces), decoder(pieces)

        def step(doc_id, text):
            ids, ends = to_ids([t or "" for t in text])
            back, data = to_text(ids, ends), memoryview(ids.astype("<i4", copy=False).view(np.uint8))
            return {
                "doc_id": pa.array(doc_id, pa.int64()),
                "n_ids": pa.array(np.diff(ends), pa.int64()),
                "ids": id_lists(ids, ends),
                "ids_crc32": pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])], pa.int64()),
                "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                "round_trip": pa.array([(t or "") == b for t, b in zip(text, back)], pa.bool_()),
            }

        return step

    schema = "doc_id long, n_ids long, ids array<int>, ids_crc32 long, decoded_sha256 string, round_trip boolean"
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, schema)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))
