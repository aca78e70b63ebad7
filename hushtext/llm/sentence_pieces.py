"""SentencePiece encoding and decoding over a shared prefix.

A text is cut into marked words (the mark stands for a space).  The distinct words of a
batch are sorted, which is the depth-first order of their trie; the forward state of a
prefix is computed once and kept while the words below that prefix are visited.

The forward state depends on the kind of model.  For a unigram model it is the best
score of the prefix and the piece that ends it (Viterbi).  A model of merges has no
scores that could be summed: there the state is the one piece that ends the merged form
of the prefix.  It is the piece ``t`` for which the prefix without ``t`` ends in ``s`` and
merging ``s + t`` from scratch gives ``s, t`` again.  So both kinds give the very ids of
the public library.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from hushtext.llm.common import slices

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_MAX_WORDS = 120_000  # remembered since the memory was last aged; twice that in all
_MAX_PAIRS = 250_000
_CHUNK_BYTES = 1_500_000  # of texts whose words are learned together


@dataclass(frozen=True)
class PieceModel:
    """Pieces with ids and scores; ``bytes_``: ids of the byte pieces."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_: dict[int, int]
    unknown: int
    merges: bool
    names: tuple[str, ...]


def load_model(path: str = MODEL_PATH) -> PieceModel:
    """Read a model file; merge and unigram models without text normalisation."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    rules = model.normalizer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix:
        raise ValueError("the model normalises texts, so they could not be restored")
    ids, scores, bytes_, unknown = {}, {}, {}, 0
    for number, piece in enumerate(model.pieces):
        if piece.type == piece.BYTE:
            bytes_[int(piece.piece[3:5], 16)] = number
        elif piece.type == piece.UNKNOWN:
            unknown = number
        elif piece.type == piece.NORMAL:
            ids[piece.piece], scores[piece.piece] = number, piece.score
    if any(MARK in p.lstrip(MARK) for p in ids):
        raise ValueError("a piece goes over the beginning of a word")
    merges = model.trainer_spec.model_type == model.trainer_spec.BPE
    names = tuple(p.piece for p in model.pieces)
    return PieceModel(ids, scores, bytes_, unknown, merges, names)


def _word_pattern(pieces: Iterable[str]) -> re.Pattern:
    """Marked words, cut finer where no piece reaches over, so that words repeat more.

    A line break that is in no piece stands alone, digits do if no piece joins them to
    anything, and letters part from other characters if no piece holds both kinds.
    """
    bare = [p.lstrip(MARK) for p in pieces]
    pairs = {x + y for p in bare for x, y in zip(p, p[1:], strict=False)}
    alone = "" if any("\n" in p for p in bare) else r"\n"
    digits = not any(re.search(r"\d", pair) for pair in pairs)
    # other numerals than digits, such as a raised 2, are no letters
    numerals = "".join(sorted({c for p in bare for c in p if c.isnumeric() and not c.isalpha()}))
    letter, other = rf"[^\W\d_{numerals}]", rf"[\W\d_{numerals}]"
    kinds = not any(re.search(f"{letter}{other}|{other}{letter}", pair) for pair in pairs)
    rest = f"{MARK}{alone}" + r"\d" * digits
    runs = f"{letter}+|(?:(?![{rest}]){other})+" if kinds else f"[^{rest}]+"
    lone = r"\d|" * digits
    return re.compile(rf"{MARK}*(?:{lone}{runs})|{MARK}+" + f"|{alone}" * bool(alone))


class _PackedIds(dict):
    """Ids of a piece, four bytes each; a single character that is no piece is spelled."""

    def __init__(self, model: PieceModel):
        self.model = model
        super().__init__((p, _packed([number])) for p, number in model.ids.items())

    def __missing__(self, piece: str) -> bytes:
        if self.model.bytes_:
            return _packed([self.model.bytes_[b] for b in piece.encode("utf-8", "replace")])
        return _packed([self.model.unknown])


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


@dataclass
class Encoder:
    model: PieceModel
    words: dict[str, bytes] = field(default_factory=dict)  # ids, four bytes each
    older: dict[str, bytes] = field(default_factory=dict)
    pairs: dict[str, dict[str, bool]] = field(default_factory=dict)  # by left piece
    known_pairs: int = 0

    def __post_init__(self):
        # endings of pieces: a suffix that ends no piece has no longer one that does
        self.endings = {p[i:] for p in self.model.ids for i in range(len(p))}
        self.least = min(self.model.scores.values(), default=0.0) - 10
        # bytes of each id, the mark as a space; byte pieces as they are
        self.raw = [name.replace(MARK, " ").encode() for name in self.model.names]
        for byte, number in self.model.bytes_.items():
            self.raw[number] = bytes([byte])
        self.packed = _PackedIds(self.model)
        self.cut = _word_pattern(self.model.ids)

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids of each text; none for null and empty texts.

        The distinct words of all ``texts`` are learned together.
        """
        cut = [self.cut.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.words) > _MAX_WORDS:
            # words not met since the last time are forgotten, rare ones that is
            self.older, self.words = self.words, {}
        known, older = self.words, self.older
        new = set(chain.from_iterable(cut)).difference(known)
        for word in older.keys() & new:
            known[word] = older[word]
        self._learn(sorted(new.difference(older)))
        of_word = known.__getitem__
        return [np.frombuffer(b"".join(map(of_word, words)), np.int32) for words in cut]

    def _learn(self, words: list[str]) -> None:
        """Encode sorted words, reusing the states of shared beginnings."""
        scores, endings = self.model.scores, self.endings
        merges, least, packed = self.model.merges, self.least, self.packed
        last: list[str] = [""]  # the piece that ends each prefix
        best: list[float] = [0.0]  # its score, for unigram models
        rights: list[dict[str, bool]] = [self._rights("")]  # what it is known to stand before
        before = ""
        for word in words:
            shared = len(os.path.commonprefix((before, word)))
            del last[shared + 1 :], best[shared + 1 :], rights[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                start = end - 1
                piece = word[start:end]
                winner, top = "", 0.0
                while True:
                    if start == end - 1 or piece in scores:
                        if merges:
                            fits = rights[start].get(piece)
                            if fits is None:
                                fits = rights[start][piece] = self._pair(last[start], piece)
                            if fits:
                                winner = piece
                                break
                        else:
                            score = best[start] + scores.get(piece, least)
                            if not winner or score > top:
                                winner, top = piece, score
                    start -= 1
                    if start < 0 or piece not in endings:
                        break
                    piece = word[start:end]
                    if piece not in endings:
                        break
                last.append(winner)
                best.append(top)
                if merges:
                    rights.append(self._rights(winner))
            pieces, at = [], len(word)
            while at:
                pieces.append(last[at])
                at -= len(pieces[-1])
            pieces.reverse()
            self.words[word] = b"".join(map(packed.__getitem__, pieces))
            before = word

    def _rights(self, left: str) -> dict[str, bool]:
        found = self.pairs.get(left)
        if found is None:
            found = self.pairs[left] = {}
        return found

    def _pair(self, left: str, right: str) -> bool:
        """Whether two pieces stay as they are when merged from scratch."""
        self.known_pairs += 1
        if self.known_pairs > _MAX_PAIRS:
            self.known_pairs = 0
            for known in self.pairs.values():
                known.clear()
        return self.merged(left + right) == ([left, right] if left else [right])

    def merged(self, word: str) -> list[str]:
        """Merges from scratch: the best scored neighbours first, then the leftmost."""
        parts, scores = list(word), self.model.scores
        while len(parts) > 1:
            best = None
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best[0]):
                    best = score, i
            if best is None:
                break
            at = best[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def piece_encoder(spark, model: PieceModel):
    """Column function from a text to ``struct<ids, n_pieces, restored>``.

    ``restored`` says whether decoding gives the text again; it does unless the text
    holds the mark itself or half a surrogate pair.  Null and empty texts have no ids and
    are restored as the empty text.  The model (a vocabulary of fixed size) is sent to
    each executor once.
    """
    sent = spark.sparkContext.broadcast(tuple(vars(model).values()))

    @F.arrow_udf("ids array<int>, n_pieces int, restored boolean")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(sent)
        for batch in batches:
            # a few texts at a time, so that memory follows them and not the batch
            for part in slices(batch, _CHUNK_BYTES):
                texts = part.to_pylist()
                ids = encoder.encode(texts)
                same = [_decoded(encoder, i) == (t or "") for i, t in zip(ids, texts, strict=True)]
                sizes = np.array([i.size for i in ids], np.int32)
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, np.concatenate(ids))
                yield pa.StructArray.from_arrays(
                    [lists, pa.array(sizes), pa.array(same, pa.bool_())],
                    ["ids", "n_pieces", "restored"],
                )

    return encode


def piece_decoder(spark, model: PieceModel):
    """Column function from an array of ids to the text; null stays null."""
    sent = spark.sparkContext.broadcast(tuple(vars(model).values()))

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(sent)
        for batch in batches:
            for part in slices(batch, _CHUNK_BYTES):
                texts = (None if i is None else encoder.decode(i) for i in part.to_pylist())
                yield pa.array(texts, pa.string())

    return decode


def _decoded(encoder: Encoder, ids: np.ndarray) -> str:
    return encoder.decode(ids.tolist())


_kept: dict[int, Encoder] = {}


def _encoder(sent) -> Encoder:
    """One encoder per task, so that its words serve all batches."""
    if not _kept:
        _kept[0] = Encoder(PieceModel(*sent.value))
    return _kept[0]
