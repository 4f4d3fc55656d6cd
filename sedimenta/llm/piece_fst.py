"""A weighted transducer for piece models, and its shortest path.

The compiled machine is the composition of three parts:

* the normaliser: spaces become the visible space U+2581, and a dummy prefix of one is put in front of a text;
* the pieces: one arc from position i to j for every piece that spells the characters i..j;
* byte fallback: an arc for every single character, which stands for the bytes of that character where it is no piece.

For a unigram model an arc weighs minus the piece's score, and the path of least total weight in the tropical semiring (min, +) is
the encoding.  A merge (BPE) model is not additive, but it is local: a sequence of pieces is the encoding of its text exactly if every
two neighbours are the encoding of theirs.  (Up to the first merge over some boundary, both sides evolve as they do alone; so such a
merge happens in the whole exactly if it happens in the pair.)  Here the state also holds the last piece, an arc leaves it only where
the pair is stable, and every arc weighs one.  As the encoding of each prefix is unique, each position has one reachable state, and the
distance to it is the exact token count of that prefix.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from operator import sub

import ahocorasick
import numpy as np

SPACE = "▁"
NORMAL, UNKNOWN, BYTE = 1, 2, 6
UNIGRAM, BPE = 1, 2


class _Labels(dict):
    """What a label spells."""

    def __missing__(self, label: int) -> str:
        return chr(-1 - label)


class _Any(dict):
    """Before the first label, and after a character that is no piece, anything may follow."""

    def get(self, label: int, default=None) -> bool:
        return True


ANY = _Any()


class PieceTransducer:
    """Compiled from the file of a piece model.  ``cache`` bounds the number of remembered stretches and words (of each, twice as many at most) and of remembered pairs (eight times as many)."""

    def __init__(self, path: str, cache: int = 100_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, kind = proto.normalizer_spec, proto.trainer_spec.model_type
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only the identity normaliser with escaped spaces is supported")
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and merge models are supported")
        if {p.type for p in proto.pieces} - {NORMAL, UNKNOWN, 3, BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        self.bpe, self.prefix = kind == BPE, SPACE if norm.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.bytes_at = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.fallback = len(self.bytes_at) == 256
        self.spelled = [p.piece.replace(SPACE, " ").encode() if p.type == NORMAL else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else " ⁇ ".encode() if p.type == UNKNOWN else b"" for p in proto.pieces]
        self.least = min(self.scores.values(), default=0.0) - 10.0
        self.cache, self.pairs, self.n_pairs = cache, defaultdict(dict), 0
        self.forget()
        self.sizes = [len(p.piece) for p in proto.pieces]
        self.labels = _Labels({i: p for p, i in self.ids.items()})
        self.whole = {p for p in self.ids if not self.bpe or self._merged(p) == [p]}
        self.arcs = ahocorasick.Automaton()
        for piece in self.whole:
            self.arcs.add_word(piece, (self.ids[piece], len(piece)))
        self.arcs.make_automaton()
        many = [p for p in self.ids if len(p) > 1]
        inside = set("".join(many))
        alone = "".join(c for c in map(chr, range(128)) if c not in inside and c != " ")
        self.by_space = bool(self.prefix) and not any(SPACE in p.lstrip(SPACE) for p in many)
        if not self.by_space:
            self.stretch = re.compile(r"(?s).+")
        elif alone:
            own = re.escape(alone)
            self.stretch = re.compile(f" +[^ {own}]*|[^ {own}]+|[{own}]")
        else:
            self.stretch = re.compile(r" +[^ ]*|[^ ]+")

    def forget(self) -> None:
        """Drops the remembered stretches and words; pairs stay."""
        self.young, self.old, self.words, self.old_words = {}, {}, {}, {}
        self.steps, self.old_steps = [{}, {}], [{}, {}]

    def _merged(self, text: str) -> list[str]:
        """The merge process itself, for pairs of pieces: the best adjacent pair goes first, the leftmost of equals."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stable(self, a: int, b: int) -> bool:
        """Whether label a before label b is the encoding of both."""
        if self.n_pairs >= 8 * self.cache:
            self.pairs, self.n_pairs = defaultdict(dict), 0
        x, y = self.labels[a], self.labels[b]
        known = self.pairs[a][b] = x + y not in self.whole and self._merged(x + y) == [x, y]
        self.n_pairs += 1
        return known

    def _tokens(self, label: int) -> list[int]:
        """A label's ids: itself if it is a piece, else its bytes."""
        if label >= 0:
            return [label]
        return [self.bytes_at[b] for b in self.labels[label].encode("utf-8", "replace")] if self.fallback else [self.unknown]

    def _states(self, text: str) -> list[int]:
        """The last label of every position's one reachable state, for merge models.

        Labels are piece ids, or -1 - code point for a single character that is no piece.  Arcs come by their end, longest first, so
        positions get their states in order; ``after`` holds what is known of the labels that may follow each.
        """
        last, after, done, stable = [-1], [ANY], 0, self._stable
        for end, (label, size) in self.arcs.iter(text):
            if end < done:
                continue
            while done < end:
                done += 1
                last.append(-1 - ord(text[done - 1]))
                after.append(ANY)
            ok = after[end + 1 - size].get(label)
            if ok or ok is None and stable(last[end + 1 - size], label):
                done = end + 1
                last.append(label)
                after.append(self.pairs[label])
        for c in text[done:]:
            last.append(-1 - ord(c))
        return last

    def _counts(self, text: str) -> list[int]:
        """The token count of every prefix: that of the place where the last label of its best path begins, and the label's own."""
        last, counts = self._states(text) if self.bpe else self._lattice(text)[1], [0]
        for j in range(1, len(last)):
            label = last[j]
            counts.append(counts[j - self.sizes[label]] + 1 if label >= 0 else counts[j - 1] + len(self._tokens(label)))
        return counts

    def _lattice(self, text: str) -> tuple[list, list]:
        """Distance and last label of every position's best state, for unigram models."""
        dist: list = [0]
        n, scores = len(text), self.scores
        dist += [None] * n
        last, done = [-1] * (n + 1), 0
        for end, (label, size) in [*self.arcs.iter(text), (n, (None, 0))]:
            while done < end:
                done += 1
                if dist[done] is None:  # a character that is no piece
                    dist[done], last[done] = dist[done - 1] - self.least, -1 - ord(text[done - 1])
            if label is not None:
                w = dist[end + 1 - size] - scores[self.labels[label]]
                if dist[end + 1] is None or w < dist[end + 1]:
                    dist[end + 1], last[end + 1] = w, label
        return dist, last

    def _path(self, text: str) -> list[int]:
        last = self._states(text) if self.bpe else self._lattice(text)[1]
        out, j, size = [], len(text), self.sizes
        while j:
            label = last[j]
            if label >= 0:
                out.append(label)
                j -= size[label]
            else:
                out += reversed(self._tokens(label))
                j -= 1
        out.reverse()
        return out

    def _ids_of(self, stretch: str) -> bytes:
        return array("i", self._path(stretch.replace(" ", SPACE))).tobytes()

    def _packed(self, stretch: str, worded: bool) -> bytes:
        """Ids of a stretch, or of a word (a stretch without its leading space, and all that follows up to the next space)."""
        old, young = (self.old_words, self.words) if worded else (self.old, self.young)
        known = young.get(stretch) or old.get(stretch)
        if known is None:
            known = b"".join(map(self._ids_of, self.stretch.findall(" " + stretch))) if worded else self._ids_of(stretch)
        if len(stretch) <= 64:
            young[stretch] = known
            if len(young) >= self.cache:
                if worded:
                    self.old_words, self.words = young, {}
                else:
                    self.old, self.young = young, {}
        return known

    def _stretches(self, text: str) -> list[str]:
        """Parts that no piece spans: their encodings are independent."""
        return self.stretch.findall((self.prefix + text).replace(SPACE, " ")) if text else []

    def _worded(self, text: str) -> bool:
        """Whether a text can be cut at its spaces: there are no runs of spaces."""
        return self.by_space and bool(text) and "  " not in text and SPACE not in text and text[0] != " "

    def _parts(self, text: str) -> list[bytes]:
        """The packed ids of all parts of a text.  Texts without runs of spaces are cut at their spaces, which is faster."""
        if not text:
            return []
        if self._worded(text):
            get, packed = self.words.get, self._packed
            return [get(w) or packed(w, True) for w in text.split(" ")]
        get, packed = self.young.get, self._packed
        return [get(s) or packed(s, False) for s in self._stretches(text)]

    def encode_packed(self, text: str) -> bytes:
        """The ids of a whole text as 32-bit integers."""
        return b"".join(self._parts(text))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "i4").tolist()

    def decode(self, ids) -> str:
        """The text that the ids spell, without the dummy prefix."""
        spelled = self.spelled
        text = b"".join([spelled[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def _steps(self, stretch: str, worded: bool) -> bytes:
        """By how much each character of a stretch (or of a word, its space first) changes the count of the prefix that ends with it, as 32-bit integers."""
        at = int(worded)
        known = self.steps[at].get(stretch) or self.old_steps[at].get(stretch)
        if known is None:
            out = array("i")
            for part in self.stretch.findall(" " + stretch) if worded else [stretch]:
                counts = self._counts(part.replace(" ", SPACE))
                out.extend(map(sub, counts[1:], counts))
            known = out.tobytes()
        if len(stretch) <= 64:
            self.steps[at][stretch] = known
            if len(self.steps[at]) >= self.cache:
                self.old_steps[at], self.steps[at] = self.steps[at], {}
        return known

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token counts of text[:0], text[:1], ..., text: running sums over the remembered steps of its parts.  Answers any budget question without encoding again."""
        if not text:
            return np.zeros(1, "int64")
        worded = self._worded(text)
        get, steps = self.steps[worded].get, self._steps
        counts = np.frombuffer(b"".join([get(s) or steps(s, worded) for s in (text.split(" ") if worded else self._stretches(text))]), "i4").cumsum(dtype="int64")
        if not self.prefix:
            return np.concatenate([[0], counts])
        counts[0] = 0  # the place after the dummy prefix is that of the empty text
        return counts

    def longest_prefix(self, text: str, budget: int) -> int:
        """The most characters k such that text[:k] has at most ``budget`` tokens, and so has every shorter prefix."""
        return fitting(self.prefix_counts(text), budget)


def fitting(counts: np.ndarray, budget: int) -> int:
    """The last place of ``counts`` up to which none is above the budget."""
    over = counts > budget
    return int(over.argmax()) - 1 if over.any() else len(counts) - 1
