"""SentencePiece (merge type) encoding by a prefix table, and decoding.

A text is encoded in one pass from left to right. For every prefix the table holds the last token of that prefix's
encoding. That token is unique: among the pieces which an Aho-Corasick automaton finds to end here, it is the one that
stays next to the last token of the prefix before it when the two alone are encoded. The ids are then recovered
backwards. Pair tests are answered by merging the two pieces' characters, and remembered.

No piece of the vocabulary goes on past a space mark that follows another character, so a text falls into parts that
cannot influence each other, which are encoded once each and remembered as well. If a vocabulary has such pieces, or
holds characters that are normalised, the constructor refuses it.

Defined results: a null text is an empty text, whose only id is the end id; an unknown character becomes the byte
pieces of its UTF-8 form; repeated rows give repeated results; memories are bounded and emptied when they are full.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, spread, table

MARK = "▁"
#: Entries at which a memory of parts or pairs is emptied; parts longer than LONG characters are not remembered.
MEMORY = 500_000
LONG = 48

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class PieceEncoder:
    """Encodes and decodes as the library does, for merge-type models without normalisation."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        probe = "ﬁ Å  \t\n　x "
        if model.normalize(probe) != (MARK + probe).replace(" ", MARK):
            raise ValueError("the model normalises its input")
        ids = range(model.get_piece_size())
        self.end = model.eos_id()
        self.text_of = {i: model.id_to_piece(i) for i in ids}
        self.bytes_of = {i: int(self.text_of[i][3:5], 16) for i in ids if model.is_byte(i)}
        self.byte_ids = [i for i, _ in sorted(self.bytes_of.items(), key=lambda x: x[1])]
        self.silent = {i for i in ids if model.is_control(i)}
        self.odd = self.silent | set(self.bytes_of)
        special = self.silent | set(self.bytes_of) | {i for i in ids if model.is_unknown(i)}
        self.score = {self.text_of[i]: model.get_score(i) for i in ids if i not in special}
        self.id_of = {self.text_of[i]: i for i in ids if i not in special}
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("a piece goes on past a space mark")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            # A piece that its own characters do not merge to is never produced.
            if len(p) == 1 or self.merged(p) == [p]:
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.length = [len(self.text_of[i]) for i in ids]
        self.shown = [str(i) for i in ids]
        self.pairs: dict[int, bool] = {}
        self.parts: dict[str, str] = {}
        self.unlike: dict[str, str] = {}
        #: A part: space marks and what follows them, or a run of characters that no piece joins to others.
        joined = {c for p in self.id_of if len(p) > 1 for c in p}
        self.alone = {c for c in "\n\t\r" if c not in joined}
        stop = "".join(map(re.escape, self.alone))
        self.cut = re.compile(rf"[{stop}]+|{MARK}*[^{MARK}{stop}]+|{MARK}+" if stop else rf"{MARK}*[^{MARK}]+|{MARK}+")

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging the best-scored neighbours, the leftmost of equals first."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays(self, left: int, right: int) -> bool:
        """Whether the two pieces remain when their joined text is encoded."""
        if len(self.pairs) >= MEMORY:
            self.pairs.clear()
        two = [self.text_of[left], self.text_of[right]]
        known = self.pairs[left << 20 | right] = self.merged("".join(two)) == two
        return known

    def ids(self, text: str) -> list[int]:
        """Ids of a part by the prefix table.

        tail[n]: the last piece of the first n characters; -1 where no piece can end, which is after a character
        outside the vocabulary: nothing merges with it, so any piece may follow.
        """
        tail = [-1] * (len(text) + 1)
        length, known, stays = self.length, self.pairs.get, self.stays
        for last, piece in self.automaton.iter(text):
            if tail[last + 1] < 0:
                start = last + 1 - length[piece]
                before = tail[start]
                if before < 0 or not start:
                    tail[last + 1] = piece
                else:
                    fits = known(before << 20 | piece)
                    if fits or (fits is None and stays(before, piece)):
                        tail[last + 1] = piece
        out = []
        at = len(text)
        while at:
            piece = tail[at]
            if piece < 0:
                at -= 1
                out += [self.byte_ids[b] for b in reversed(text[at].encode("utf-8", "surrogatepass"))]
            else:
                at -= length[piece]
                out.append(piece)
        out.reverse()
        return out

    def _part(self, text: str) -> str:
        """The decimal ids of a part. Parts that do not decode to themselves (marks as blanks) are noted."""
        ids = self.ids(text)
        made = " ".join([self.shown[i] for i in ids])
        plain = self._plain(ids)
        if plain != text.replace(MARK, " "):
            self.unlike[text] = plain
        elif len(text) <= LONG:
            if len(self.parts) >= MEMORY:
                self.parts.clear()
            self.parts[text] = made
        return made

    def _plain(self, ids: list[int]) -> str:
        """The text of ids, space marks still as blanks; byte pieces are joined and read as UTF-8."""
        if self.odd.isdisjoint(ids):
            return "".join([self.text_of[i] for i in ids]).replace(MARK, " ")
        out, run = [], bytearray()
        for i in ids:
            if i in self.bytes_of:
                run.append(self.bytes_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if i not in self.silent:
                out.append(self.text_of[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")

    def _marked(self, text: str) -> list[str]:
        return self.cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        """All ids of a text, the end id last."""
        return [i for p in self._marked(text) for i in self.ids(p)] + [self.end]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the blank put before a text goes."""
        return self._plain(ids).removeprefix(" ")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, their decimal list, and the decoded text.

        Byte runs never cross parts, so the parts' texts joined are the text of all ids.
        """
        known, part = self.parts.get, self._part
        parts = self._marked(text)
        self.unlike.clear()
        found = [known(p) or part(p) for p in parts]
        found.append(self.shown[self.end])
        shown = " ".join(found)
        if self.unlike:
            plain = "".join([self.unlike.get(p) or p.replace(MARK, " ") for p in parts])
        else:
            plain = "".join(parts).replace(MARK, " ")
        return shown.count(" ") + 1, shown, plain.removeprefix(" ")


_encoders: dict[str, PieceEncoder] = {}


def encoder(model_file: str) -> PieceEncoder:
    """One encoder a worker and model."""
    if model_file not in _encoders:
        _encoders[model_file] = PieceEncoder(model_file)
    return _encoders[model_file]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encoded(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_file)
        for b in batches:
            made = [enc.digest(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array([m[0] for m in made], pa.int64()), pa.array([sha(m[1]) for m in made], pa.string()), pa.array([sha(m[2]) for m in made], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    small_batches(docs.sparkSession)
    return spread(docs.select("doc_id", "text")).mapInArrow(run, SCHEMA)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_piece_ids(spark, sf_dir: str) -> DataFrame:
    """Every document's ids and decoded text, as digests."""
    return encoded(table(spark, sf_dir, "documents"), default_model())
