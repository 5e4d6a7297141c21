"""Sentence pieces: exact encoding of merge-type (BPE) models by a prefix table, and decoding.

A merge-type model joins the best-scored neighbours (the leftmost of equals) until no two neighbours form a piece. Merges
inside a piece of the result see nothing of what lies outside, so a row of pieces is the encoding of its text if and only
if every two neighbours are the encoding of their own text. So the last piece of every prefix is unique: it is the piece t,
among those that an Aho-Corasick automaton finds to end there, whose pair with the last piece of the prefix before t holds.
The table of last pieces is filled from left to right, and the ids are read from it backwards.

A pair holds if no merge crosses its border while both pieces grow from characters: both histories are followed together,
best score first, and the pair falls as soon as the symbols beside the border form a piece that goes before both next
merges. Histories and pairs are remembered. Characters that stand alone in no piece become their UTF-8 bytes' pieces.

Where no piece holds a space behind another character, texts are cut before each run of spaces, and at characters that are
in no piece; short stretches are remembered with their ids, in bounded memory, long ones (a text without spaces) go through
the table at a cost in proportion to their length.

Decoding joins the pieces of the ids: spaces for their marks, the space in front dropped, byte pieces as UTF-8.

Null texts are empty texts and have no ids. Every row is encoded by itself: repeated rows and null ids come out as often as
they come in, other columns are ignored, an empty table has no rows. Models that normalize texts, mark user-defined pieces,
sample, or have no byte pieces are refused with an error.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from inkwell.llm.common import ship

ship(__name__)

SPACE = "▁"
#: Stretches of up to so many characters are remembered, so many of them, and so many characters in all.
SHORT = 48
REMEMBERED = 250_000
REMEMBERED_CHARS = 4_000_000
#: Remembered pairs.
PAIRS = 1_000_000

NORMAL, UNKNOWN, BYTE = 1, 2, 6


class Pieces:
    """The pieces of a model file: ids of a text, and the text of ids."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        told, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a merge-type model with byte pieces and spaces in front is needed")
        if told.precompiled_charsmap or told.remove_extra_whitespaces or not told.add_dummy_prefix or not told.escape_whitespaces or kinds & {4, 5}:
            raise ValueError("models that normalize texts, or have user-defined or unused pieces, aren't encoded")
        self.piece = [p.piece for p in model.pieces]
        self.kind = [p.type for p in model.pieces]
        #: ids and scores of the pieces that merges may form
        self.id_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        #: Atoms: single characters inside pieces; those that aren't pieces themselves are told apart by ids behind the last.
        self.symbols = list(self.piece)
        atoms = {c for p in self.id_of for c in p}
        loose = sorted(atoms - set(self.id_of))
        self.number = self.id_of | {c: len(self.piece) + i for i, c in enumerate(loose)}
        self.symbols += loose
        self.decimal = [str(i) for i in range(len(self.piece))]
        self.plain = [p.replace(SPACE, " ") if k == NORMAL else None for p, k in zip(self.piece, self.kind)]
        self.sizes = [len(s) for s in self.symbols]
        self.histories: dict[int, tuple] = {}
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for text, i in self.number.items():
            if len(text) == 1 or self.history(i)[1]:  # pieces that merges never reach end no prefix
                self.automaton.add_word(text, i)
        self.automaton.make_automaton()
        self.outside = re.compile(f"[^{re.escape(''.join(sorted(atoms)))}]")
        cuts = not any(SPACE in p.lstrip(SPACE) for p in self.id_of)
        self.stretch = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if cuts else re.compile("(?s).+")
        self.known: dict[str, tuple] = {}
        self.held = 0

    def history(self, i: int) -> tuple[list, bool]:
        """The merges by which a piece grows by itself, [score, first symbol, last symbol after it], and whether they reach it."""
        got = self.histories.get(i)
        if got is None:
            parts, steps, score = list(self.symbols[i]), [], self.score
            steps.append((0.0, parts[0], parts[-1]))
            while len(parts) > 1:
                best, at = None, -1
                for j in range(len(parts) - 1):
                    s = score.get(parts[j] + parts[j + 1])
                    if s is not None and (best is None or s > best):
                        best, at = s, j
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                steps.append((best, parts[0], parts[-1]))
            got = self.histories[i] = (steps, len(parts) == 1)
        return got

    def holds(self, a: int, b: int) -> bool:
        """Whether the text of two pieces is encoded as these two; remembered."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        got = self.pairs[a * len(self.symbols) + b] = self._apart(self.history(a)[0], self.history(b)[0])
        return got

    def _apart(self, left: list, right: list) -> bool:
        x = y = 0
        score, low = self.score, float("-inf")
        while True:
            crossing = score.get(left[x][2] + right[y][1])
            of_left = left[x + 1][0] if x + 1 < len(left) else low
            of_right = right[y + 1][0] if y + 1 < len(right) else low
            if crossing is not None and crossing > of_left and crossing >= of_right:
                return False  # of equal scores the leftmost goes first: those of the left piece, the crossing one, the right's
            if of_left == low and of_right == low:
                return True
            if of_left >= of_right:
                x += 1
            else:
                y += 1

    def _encoded(self, text: str) -> list[int]:
        """Ids of a stretch in which every character stands in some piece."""
        last, pairs, holds, n = [-1] * (len(text) + 1), self.pairs, self.holds, len(self.symbols)
        sizes = self.sizes
        for end, i in self.automaton.iter(text):
            if last[end + 1] < 0:  # not yet found: there is only one
                before = end + 1 - sizes[i]
                if before:
                    a = last[before]
                    if a >= 0:
                        ok = pairs.get(a * n + i)
                        if holds(a, i) if ok is None else ok:
                            last[end + 1] = i
                else:
                    last[end + 1] = i
        out, at = [], len(text)
        while at:
            i = last[at]
            out.append(i)
            at -= sizes[i]
        out.reverse()
        if max(out) >= len(self.piece):  # atoms without a piece of their own
            return [k for i in out for k in ([i] if i < len(self.piece) else self._bytes(self.symbols[i]))]
        return out

    def _bytes(self, text: str) -> list[int]:
        return [self.byte_id[b] for b in text.encode("utf-8")]

    def _ids(self, text: str) -> list[int]:
        if not self.outside.search(text):
            return self._encoded(text)
        out, at = [], 0
        for m in self.outside.finditer(text):
            if m.start() > at:
                out += self._encoded(text[at : m.start()])
            out += self._bytes(m[0])
            at = m.end()
        return out + self._encoded(text[at:]) if at < len(text) else out

    def stretches(self, text: str) -> Iterable[str]:
        """What a text is cut into: with the mark in front, spaces as marks."""
        return self.stretch.findall(SPACE + text.replace(" ", SPACE)) if text else ()

    def entry(self, stretch: str) -> tuple[int, str, str]:
        """A stretch's number of ids, the ids in decimal, and their text."""
        got = self.known.get(stretch)
        if got is None:
            ids = self._ids(stretch)
            got = (len(ids), ",".join([self.decimal[i] for i in ids]), self.text(ids))
            if len(stretch) <= SHORT:
                if len(self.known) >= REMEMBERED or self.held > REMEMBERED_CHARS:
                    self.known.clear()
                    self.held = 0
                self.known[stretch] = got
                self.held += len(stretch)
        return got

    def encode(self, text: str) -> list[int]:
        return [i for s in self.stretches(text) for i in self._ids(s)]

    def text(self, ids: Iterable[int]) -> str:
        """The text of ids, the space in front kept; control pieces have none, an unknown piece is a mark between spaces."""
        out, held, plain = [], bytearray(), self.plain
        for i in ids:
            if not held and plain[i] is not None:
                out.append(plain[i])
                continue
            if self.kind[i] == BYTE:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            out.append(plain[i] if plain[i] is not None else " ⁇ " if self.kind[i] == UNKNOWN else "")
        if held:
            out.append(_utf8(bytes(held)))
        return "".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids as the library gives it: without the space that encoding puts in front."""
        ids = list(ids)
        first = next((k for k, i in enumerate(ids) if self.kind[i] in (NORMAL, BYTE, UNKNOWN)), len(ids))
        text = self.text(ids)
        return text[1:] if first < len(ids) and self.kind[ids[first]] == NORMAL and self.piece[ids[first]].startswith(SPACE) else text


def _utf8(held: bytes) -> str:
    """Bytes as UTF-8, each byte that belongs to no character as one replacement character."""
    return "".join("\ufffd" if "\udc80" <= c <= "\udcff" else c for c in held.decode("utf-8", "surrogateescape"))


def _coder(path: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Pieces(path)
        for f in frames:
            rows = []
            for text in f["text"]:
                found = [pieces.entry(s) for s in pieces.stretches(text or "")]
                ids, said = ",".join([e[1] for e in found]), "".join([e[2] for e in found])[1:]
                rows.append((sum([e[0] for e in found]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", f["doc_id"].astype("Int64").to_numpy())
            yield out.astype({"doc_id": "Int64"})

    return run


def _listing(path: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Pieces(path)
        for f in frames:
            ids = [pieces.encode(t or "") for t in f["text"]]
            out = pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "ids": ids, "decoded": [pieces.decode(i) for i in ids]})
            yield out

    return run


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (array) and decoded, the text of these ids. model: path of a model file on every machine."""
    return docs.select("doc_id", "text").mapInPandas(_listing(model), "doc_id long, ids array<int>, decoded string")


def fingerprints(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by commas) and decoded_sha256, both in lowercase hex."""
    return docs.select("doc_id", "text").mapInPandas(_coder(model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
