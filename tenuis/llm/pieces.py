"""The pieces of a public vocabulary, as needed for lattices over texts.

A text gets one leading space. A piece's word mark is a space here, so a literal U+2581 in a text is an ordinary
character. Characters without a piece of their own become the byte pieces of their UTF-8 form.

No piece of the vocabulary holds a space after another character, and none holds a line feed; `Vocabulary.read`
checks both. The lattice of a text therefore falls apart, without loss, into the lattices of its `chunks`.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"

#: Pieces with scores at or below this are spare ones (runs of spaces); they don't set the score of unknown characters.
_SPARE = -1e8

chunks = re.compile(r"\n| *[^ \n]+| +").findall


@dataclass(frozen=True)
class Vocabulary:
    """`known` maps a piece to (id, score), and a string that only begins pieces to (-1, 0.0). `surface` has the text of
    each id; for parts of a character, bytes."""

    known: dict[str, tuple[int, float]]
    surface: list[str | bytes]
    byte_ids: list[int]
    unknown: float
    longest: int

    @staticmethod
    def read(path: str = VOCABULARY) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        known: dict[str, tuple[int, float]] = {}
        surface: list[str | bytes] = []
        byte_ids = [0] * 256
        for number in range(model.get_piece_size()):
            name = model.id_to_piece(number)
            if model.is_byte(number):
                value = int(name[3:-1], 16)
                byte_ids[value] = number
                surface.append(chr(value) if value < 0x80 else bytes([value]))
                continue
            plain = name.replace("▁", " ")
            surface.append(plain)
            if model.is_control(number) or model.is_unknown(number) or model.is_unused(number):
                continue
            if re.search(r"[^ ] |\n", plain):
                raise ValueError(f"piece {number} joins two chunks")
            known[plain] = (number, model.get_score(number))
        scores = [s for _, s in known.values() if s > _SPARE]
        longest = max(map(len, known))
        for piece in list(known):
            for end in range(1, len(piece)):
                known.setdefault(piece[:end], (-1, 0.0))
        return Vocabulary(known, surface, byte_ids, min(scores) - 10.0, longest)

    def bytes_of(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]

    def decode(self, ids) -> str:
        """The text of ids from `chunks` of a text with its leading space."""
        surface, out, raw = self.surface, [], b""
        try:
            return "".join(map(surface.__getitem__, ids))
        except TypeError:
            pass  # parts of characters are joined below
        for number in ids:
            part = surface[number]
            if isinstance(part, bytes):
                raw += part
                continue
            if raw:
                out.append(raw.decode("utf-8", "surrogatepass"))
                raw = b""
            out.append(part)
        if raw:
            out.append(raw.decode("utf-8", "surrogatepass"))
        return "".join(out)


def matcher(vocabulary: Vocabulary):
    """Aho-Corasick automaton that gives (last place, (id, length, score)) of every piece in a text, by last place."""
    return _automaton(vocabulary, lambda piece, number, score: (number, len(piece), score))


def packed_matcher(vocabulary: Vocabulary):
    """The same with id * 32 + length as value, which fills arrays faster."""
    if vocabulary.longest > 31:
        raise ValueError("a piece is longer than five bits can tell")
    return _automaton(vocabulary, lambda piece, number, score: number << 5 | len(piece))


def _automaton(vocabulary: Vocabulary, value):
    machine = ahocorasick.Automaton()
    for piece, (number, score) in vocabulary.known.items():
        if number >= 0:
            machine.add_word(piece, value(piece, number, score))
    machine.make_automaton()
    return machine


def covered(vocabulary: Vocabulary) -> frozenset[str]:
    """The characters that are pieces themselves; a chunk of these needs no unknown character."""
    return frozenset(piece for piece, (number, _) in vocabulary.known.items() if len(piece) == 1 and number >= 0)


@dataclass(frozen=True)
class Steps:
    """The tree of all beginnings of pieces as a table, for walks over many texts at once. Letters are the covered characters
    that most pieces have, numbered from 1; `letter` gives the number of a code point, 0 for all others. A node's row of
    `table` holds its children by letter, 0 for none; nodes from the number of rows on have no children. `number` and `score` are those of the piece
    that ends in a node, -1 and -inf if none does."""

    letter: np.ndarray
    table: np.ndarray
    number: np.ndarray
    score: np.ndarray
    longest: int

    @staticmethod
    def of(vocabulary: Vocabulary, letters: int = 127) -> Steps:
        single, seen = covered(vocabulary), Counter()
        for piece, (number, _) in vocabulary.known.items():
            if number >= 0:
                seen.update(single.intersection(piece))
        chosen = {c: at for at, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:letters], 1)}
        starts = [piece for piece in vocabulary.known if all(map(chosen.__contains__, piece))]
        inner = {piece[:-1] for piece in starts}
        node = {piece: at for at, piece in enumerate([*sorted(inner), *(p for p in starts if p not in inner)], 1)}
        table = np.zeros((len(inner) + 1, letters + 1), dtype=np.int32)
        number, score = np.full(len(node) + 1, -1, dtype=np.int32), np.full(len(node) + 1, -np.inf)
        for piece in starts:
            table[node[piece[:-1]], chosen[piece[-1]]] = node[piece]
            if vocabulary.known[piece][0] >= 0:
                number[node[piece]], score[node[piece]] = vocabulary.known[piece]
        letter = np.zeros(0x110000, dtype=np.uint8)
        letter[[ord(c) for c in chosen]] = list(chosen.values())
        return Steps(letter, table, number, score, max(map(len, starts), default=0))

    @property
    def root(self) -> int:
        """The node of the empty beginning, which sorts first."""
        return 1


def edges(known: dict[str, tuple[int, float]], chunk: str) -> list[list[tuple[int, int, float]]]:
    """For each start, the (end, id, score) of the pieces there; id -1 and score 0 stand for an unknown character."""
    out, size = [], len(chunk)
    get = known.get
    for start in range(size):
        found = []
        for end in range(start + 1, size + 1):
            hit = get(chunk[start:end])
            if hit is None:
                break
            if hit[0] >= 0:
                found.append((end, *hit))
        if not found or found[0][0] != start + 1:
            found.append((start + 1, -1, 0.0))
        out.append(found)
    return out
