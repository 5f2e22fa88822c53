"""SentencePiece BPE encoding and decoding by a prefix table.

For every prefix of a string the last token of its encoding is unique. So one
pass over the string suffices: an automaton lists the pieces that end at each
position, and the one that is compatible with the last token of the prefix
before it is stored. Two neighbouring tokens are compatible if, undoing their
merges from the latest on, no merge across the border would have come first.
The ids are then recovered backwards from the end of the table.

The vocabulary (a fixed public table) is read on the driver and broadcast;
the workers keep it, with a bounded memo of encoded parts, between tasks. The
texts of a batch are cut wherever no piece holds two neighbouring characters
side by side (before a space or a full stop, say), as no merge crosses there;
each different part of a batch is looked up or encoded once, and the ids are
laid out by part. Encoding and decoding are one scan without a shuffle.

Defined cases: null text is empty text; empty text has no ids and decodes to
the empty string. Every row is encoded on its own, so repeated rows give
repeated results, a null ``doc_id`` is returned as it is, and an empty table
gives an empty result. The table is linear in the length of a text. Columns
other than id and text play no part and may have any name.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
# Words, or parts, of one memo generation (of two, about 220 bytes a word).
MEMO_WORDS = 150_000
MEMO_PAIRS = 150_000
MEMO_LENGTH = 64
# Characters of the texts of a batch (a longer text is one of its own) and of the slices it is cut in.
BATCH_CHARS = 500_000
SLICE_CHARS = 50_000
CHAR_KINDS = 4_000


def read_model(path: str) -> dict:
    """The tables of a SentencePiece BPE model with byte fallback: scores of
    the mergeable pieces and the id of every piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    inner = [i for i in plain if SPACE in sp.id_to_piece(i).lstrip(SPACE)]
    if inner or not all(sp.is_byte(3 + b) for b in range(256)):
        raise ValueError("a BPE model whose pieces hold spaces only in front, with 256 byte pieces from id 3, is needed")
    return {"scores": {sp.id_to_piece(i): sp.get_score(i) for i in plain},
            "ids": {sp.id_to_piece(i): i for i in plain}, "byte0": 3}


class PieceEncoder:
    """Encoder and decoder over the tables of ``read_model``."""

    def __init__(self, model: dict):
        self.model = model
        self.ready = False

    def __getstate__(self):
        return {"model": self.model}

    def __setstate__(self, state):
        self.__init__(state["model"])

    def _prepare(self) -> None:
        """Merge order, last merge of each reachable piece, automaton."""
        import ahocorasick
        import numpy as np

        self.ids, self.byte0 = self.model["ids"], self.model["byte0"]
        scores = self.model["scores"]
        order = sorted(p for p in scores if len(p) > 1)
        order.sort(key=lambda p: -scores[p])
        self.rank = {p: i for i, p in enumerate(order)}
        self.last_merge: dict[str, tuple[str, str]] = {}
        automaton = ahocorasick.Automaton()
        self.n_pairs, self.fits = 0, []
        for p in order:
            if p.strip(SPACE):  # runs of spaces are encoded by _spaces
                merged = self._merge(p)
                if merged:
                    self.last_merge[p] = merged
                    self.fits.append(_Fits(self, p))
                    automaton.add_word(p, self.fits[-1])
        automaton.add_word("\0\0", None)  # never empty
        automaton.make_automaton()
        self.automaton = automaton
        self.pieces = {i: p for p, i in self.ids.items()}
        self.memo = _Memo(self._word)
        self.parts = _Memo(self._part)
        self.side_by_side = {pair for p in self.ids for pair in zip(p, p[1:])}
        # characters by number, 0 for those that only stand alone, and whether two numbers part;
        # the last number is shared where a vocabulary has more characters, so that texts are cut less there
        chars = sorted({c for pair in self.side_by_side for c in pair}, key=lambda c: (c != SPACE, c))
        kinds = min(len(chars), CHAR_KINDS)
        self.numbers = np.zeros(0x110000, np.uint16)
        self.numbers[[ord(c) for c in chars]] = np.minimum(np.arange(1, len(chars) + 1), kinds)
        self.numbers[ord(" ")] = self.numbers[ord(SPACE)]
        self.apart = np.ones((kinds + 1, kinds + 1), bool)
        for a, b in self.side_by_side:
            self.apart[self.numbers[ord(a)], self.numbers[ord(b)]] = False
        self.spaces: dict[int, list[int]] = {}
        self.ready = True

    def _merge(self, piece: str) -> tuple[str, str] | None:
        """The last merge that forms ``piece`` from its characters; None if merging stops short."""
        parts, last = list(piece), None
        while len(parts) > 1:
            best = min(((self.rank.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] == 1 << 30:
                return None
            i = best[1]
            last = (parts[i], parts[i + 1])
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return last

    def compatible(self, a: str, b: str) -> bool:
        """Whether ``a`` and ``b`` stay neighbours when their text is encoded."""
        rank, limit = self.rank, 1 << 30
        while True:
            if rank.get(a + b, 1 << 30) < limit:
                return False
            ra = rank[a] if a in self.last_merge else -1
            rb = rank[b] if b in self.last_merge else -1
            if ra > rb:
                limit, a = ra, self.last_merge[a][1]
            elif rb < 0:
                return True
            else:
                limit, b = rb + 1, self.last_merge[b][0]

    def tokens(self, s: str) -> list[str]:
        """The pieces of a string that holds at most one space mark, in front."""
        n, known = len(s), 0
        last: list[str] = []
        for end, fits in self.automaton.iter(s):  # by end
            if known > end or fits is None:
                continue  # the last token of this prefix is known
            while known < end:
                last.append(s[known])  # no piece fits: a single character
                known += 1
            start = end - fits.size
            if start < 0 or fits[last[start]]:
                last.append(fits.piece)
                known += 1
        last.extend(s[len(last):])
        out, end = [], n - 1
        while end >= 0:
            out.append(last[end])
            end -= len(last[end])
        out.reverse()
        return out

    def _spaces(self, n: int) -> list[int]:
        """Ids of a run of ``n`` space marks: all its merges rank equal, so the leftmost goes first."""
        if n not in self.spaces:
            heads, nxt = [1] * n, [*range(1, n), -1]
            prev, alive = list(range(-1, n - 1)), [True] * n
            heap = list(range(n - 1))
            while heap:
                i = heapq.heappop(heap)
                j = nxt[i] if alive[i] else -1
                if j < 0 or SPACE * (heads[i] + heads[j]) not in self.rank:
                    continue
                heads[i] += heads[j]
                alive[j], nxt[i] = False, nxt[j]
                if nxt[j] >= 0:
                    prev[nxt[j]] = i
                heapq.heappush(heap, i)
                if prev[i] >= 0:
                    heapq.heappush(heap, prev[i])
            ids, i = [], 0
            while i >= 0 and n:
                ids.append(self.ids[SPACE * heads[i]])
                i = nxt[i]
            if len(self.spaces) > 1000:
                self.spaces.clear()
            self.spaces[n] = ids
        return self.spaces[n]

    def _spaced(self, run: int, w: str) -> list[int]:
        """Ids of a run of space marks with a word after it."""
        # the last mark of the run joins the word, if the word's own merges take it in
        ids = self.ids_of(self.tokens(SPACE + w))
        return self._spaces(run) + ids[1:] if ids[0] == self.ids[SPACE] else self._spaces(run - 1) + ids

    def ids_of(self, tokens: list[str]) -> list[int]:
        out = [self.ids.get(t) for t in tokens]
        if None not in out:
            return out
        out = []
        for t in tokens:
            i = self.ids.get(t)
            if i is None:
                out.extend(self.byte0 + b for b in t.encode())
            else:
                out.append(i)
        return out

    def pieces_text(self, ids: list[int]) -> str:
        """Text of ids before the leading space is taken off."""
        try:
            return "".join(map(self.pieces.__getitem__, ids)).replace(SPACE, " ")
        except KeyError:  # byte pieces
            out, raw = [], bytearray()
        for i in ids:
            if self.byte0 <= i < self.byte0 + 256:
                raw.append(i - self.byte0)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            out.append(self.pieces[i].replace(SPACE, " "))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        if not self.ready:
            self._prepare()
        text = self.pieces_text(ids)
        return text[1:] if text[:1] == " " else text

    def encode_words(self, text: str) -> list[tuple[str, str]]:
        """(ids joined by commas, decoded text) of each word of a text, with the spaces before it."""
        if not self.ready:
            self._prepare()
        if not text:
            return []
        out, run = [], 0
        for w in (text.replace(SPACE, " ") if SPACE in text else text).split(" "):
            run += 1
            if w:
                if run == 1:
                    out.append(_pair(self.memo[w], " " + w))
                else:
                    out.append(self.entry(self._spaced(run, w)))
                run = 0
        if run:
            out.append(self.entry(self._spaces(run)))
        return out

    def encode_text(self, text: str) -> tuple[str, str]:
        """(ids joined by commas, decoded text) of a whole text."""
        if not self.ready:
            self._prepare()
        if not text:
            return "", ""
        plain = text.replace(SPACE, " ") if SPACE in text else text
        words = plain.split(" ")
        if "" not in words:
            found = list(map(self.memo.__getitem__, words))
            try:
                return ",".join(found), plain  # every word decodes to itself
            except TypeError:
                pass
        pairs = self.encode_words(plain)
        return ",".join([ids for ids, _ in pairs]), "".join([t for _, t in pairs])[1:]

    def encode_batch(self, texts: list[str | None]) -> tuple:
        """The ids of all texts end to end, where each text's ids end (from 0 on), and the decoded texts."""
        import numpy as np
        import pyarrow as pa

        if not self.ready:
            self._prepare()
        plain = [" " + t.replace(SPACE, " ") if t else "" for t in texts]
        borders = np.cumsum([0, *map(len, plain)])
        joined = "".join(plain)
        if not joined:
            return np.zeros(0, np.int32), borders, plain
        cut, width = np.ones(len(joined) + 1, bool), np.ones(len(joined), np.uint8)
        for i in range(0, len(joined), SLICE_CHARS):  # and the first character of the next slice
            points = np.frombuffer(joined[i:i + SLICE_CHARS + 1].encode("utf-32-le"), np.uint32)
            numbers = self.numbers[points]
            cut[i + 1:i + len(points)] = self.apart[numbers[:-1], numbers[1:]]
            width[i:i + len(points)] = np.uint8(1) + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        cut[borders] = True
        cuts = np.flatnonzero(cut)
        at = np.zeros(len(cuts), np.int64)  # of each part among the bytes
        np.cumsum(np.add.reduceat(width, cuts[:-1], dtype=np.int64), out=at[1:])
        parts = pa.LargeStringArray.from_buffers(
            len(cuts) - 1, pa.py_buffer(at), pa.py_buffer(joined.encode())).dictionary_encode()
        names, codes = parts.dictionary.to_pylist(), parts.indices
        found = list(map(self.parts.__getitem__, names))
        odd = [i for i, v in enumerate(found) if not isinstance(v, str)]
        for i in odd:
            found[i], names[i] = found[i]
        ends = np.cumsum([0] + [v.count(",") + 1 for v in found], dtype=np.int32)
        ids = np.fromstring(",".join(found), np.int32, sep=",")
        taken = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)).take(codes)
        texts_at = np.searchsorted(cuts, borders)
        decoded = [t[1:] for t in plain]
        if odd:
            codes = codes.to_numpy()
            strange = np.isin(codes, odd)
            for i, (a, b) in enumerate(zip(texts_at, texts_at[1:])):
                if strange[a:b].any():
                    decoded[i] = "".join([names[c] for c in codes[a:b]])[1:]
        return taken.flatten().to_numpy(), taken.offsets.to_numpy()[texts_at], decoded

    def _word(self, word: str) -> str | tuple[str, str]:
        """The memo's value of a word without the space before it."""
        w, side_by_side = SPACE + word, self.side_by_side
        # no piece holds these two characters side by side, so no merge crosses here
        cuts = [i for i, pair in enumerate(zip(w, w[1:]), 1) if pair not in side_by_side]
        if not cuts:
            return self._part(" " + word)
        parts = [(" " + word)[i:j] for i, j in zip([0, *cuts], [*cuts, len(w)])]
        found = [_pair(self.parts[p], p) for p in parts]
        ids, text = ",".join([i for i, _ in found]), "".join([t for _, t in found])
        return ids if text == " " + word else (ids, text)

    def _part(self, part: str) -> str | tuple[str, str]:
        """The memo's value of a part, with the spaces before it."""
        w = part.replace(" ", SPACE)
        run = len(w) - len(w.lstrip(SPACE))
        if run < 2:
            found = self.ids_of(self.tokens(w))
        else:
            found = self._spaced(run, w[run:]) if w[run:] else self._spaces(run)
        ids, text = self.entry(found)
        return ids if text == part else (ids, text)

    def entry(self, ids: list[int]) -> tuple[str, str]:
        return ",".join(map(str, ids)), self.pieces_text(ids)

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.encode_words(text) for i in ids.split(",")]


def _pair(value, own: str) -> tuple[str, str]:
    """A memo's value as (ids, decoded)."""
    return (value, own) if isinstance(value, str) else value


class _Fits(dict):
    """piece before -> whether ``piece`` stays its neighbour; filled on demand."""

    __slots__ = ("encoder", "piece", "size")

    def __init__(self, encoder: PieceEncoder, piece: str):
        self.encoder, self.piece, self.size = encoder, piece, len(piece)

    def __missing__(self, before: str) -> bool:
        e = self.encoder
        if e.n_pairs >= MEMO_PAIRS:
            for known in e.fits:
                known.clear()
            e.n_pairs = 0
        e.n_pairs += 1
        value = self[before] = e.compatible(before, self.piece)
        return value


class _Memo(dict):
    """word -> its ids, where their decoded text is the word itself, else
    (ids, decoded); filled on demand. A full memo becomes the old generation:
    a word that is met again comes back from there, others go."""

    def __init__(self, encode: Callable):
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> str | tuple[str, str]:
        value = self.old.get(word) or self.encode(word)
        if len(word) <= MEMO_LENGTH:
            if len(self) >= MEMO_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = value
        return value


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded (the text that the ids stand for) and n_tokens of every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(PieceEncoder(read_model(model_path)))  # fixed size: the vocabulary

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        encoder = shared.value
        for big in batches:
            at = 0
            lengths = pc.fill_null(pc.utf8_length(big.column(1)), 0).to_numpy(zero_copy_only=False).cumsum()
            while at < big.num_rows:
                before = lengths[at - 1] if at else 0
                rows = max(1, int(lengths.searchsorted(before + BATCH_CHARS, "right")) - at)
                batch = big.slice(at, rows)
                at += rows
                ids, ends, texts = encoder.encode_batch(batch.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.string())],
                                                 ["doc_id", "ids", "decoded"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()
    return (slim.mapInArrow(encode, f"doc_id {id_type}, ids array<int>, decoded string")
            .withColumn("n_tokens", F.size("ids").cast("long")))


def with_digests(encoded: DataFrame) -> DataFrame:
    """``encoded`` with ids_sha256 (of the decimal ids joined by commas) and
    decoded_sha256 (of the decoded text in UTF-8)."""
    return encoded.withColumns({
        "ids_sha256": F.sha2(F.encode(F.concat_ws(",", F.col("ids").cast("array<string>")), "utf-8"), 256),
        "decoded_sha256": F.sha2(F.encode("decoded", "utf-8"), 256)})
