"""A sentencepiece BPE model as a deterministic transducer that counts tokens.

After each character of a text the transducer has emitted as many tokens as
the model gives for the text read so far; a transition carries the change,
which can be negative when pieces merge.

What makes this finite: in a BPE encoding every two neighbouring pieces encode
to themselves, and a sequence of pieces with that property is the encoding of
its text.  So the last piece of a prefix is the one piece that ends there and
is compatible with the last piece of the prefix before it.  A state therefore
needs only those earlier positions at which a longer piece could still start,
each with its last piece and its count relative to the present one.

Pieces hold white space (``U+2581``) at their front only, so a run of it after
another character starts afresh.  Runs are a cycle of states of their own: the
model's counts for runs are periodic.  A character outside the vocabulary
emits its UTF-8 bytes and also starts afresh.

States are compiled when a text first reaches them and kept up to a bound.
"""

from __future__ import annotations

import re

import sentencepiece

SPACE = "▁"
WORD = re.compile("▁+[^▁]*")
START = -1
LONGEST_WORD = 64
MOST_WORDS = 400_000


class State(dict):
    """Transitions: character -> (next state, emitted tokens); compiled on demand."""

    __slots__ = ("key", "machine")

    def __missing__(self, ch):
        self[ch] = out = self.machine.step(self.key, ch)
        return out


class Words(dict):
    """Transitions composed over a whole word, white space in front included."""

    __slots__ = ("machine",)

    def __missing__(self, word):
        n = self.machine.read(self.machine.state(0), word)[1]
        if len(word) <= LONGEST_WORD and len(self) < MOST_WORDS:
            self[word] = n
        return n


class PieceTransducer:
    def __init__(self, path: str, max_states: int = 200_000):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        self.score = {m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size())
                      if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}
        chars = {c for p in self.score for c in p}
        if chars - self.score.keys() or any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("the model has pieces that this transducer cannot hold")
        self.id = {p: i for i, p in enumerate(self.score)}
        self.piece = list(self.score)
        words = [p for p in self.score if not p.startswith(SPACE * 2)]
        self.open = {p[:k] for p in words for k in range(1, len(p))}
        self.words = set(words)
        self._runs()
        self.max_states = max_states
        self.states: dict = {}
        self.pairs: dict[int, bool] = {}
        self.words_read = Words()
        self.words_read.machine = self

    def _runs(self) -> None:
        """Token counts of runs of white space, and from where they repeat with which period."""
        n = 160
        self.run = [0] + [len(self.model.encode(" " * (k - 1))) if k > 1 else 1 for k in range(1, n)]
        for period in range(1, n // 3):
            gain = [self.run[k + period] - self.run[k] for k in range(n - period)]
            first = next((k for k in range(n // 3) if len(set(gain[k:])) == 1), None)
            if first is not None:
                self.cycle = (max(first, 2), period)
                return
        raise ValueError("the model's counts for white space are not periodic")


    def state(self, key) -> State:
        s = self.states.get(key)
        if s is None:
            s = State()
            s.key, s.machine = key, self
            self.states[key] = s
        return s

    def encode(self, text: str) -> list[str]:
        """The merge procedure itself, for short strings: best score first, then leftmost."""
        s = list(text)
        while len(s) > 1:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(s, s[1:])) if a + b in self.score), default=None)
            if best is None:
                break
            s[-best[1]:-best[1] + 2] = [s[-best[1]] + s[-best[1] + 1]]
        return s

    def fits(self, last: int, piece: str) -> bool:
        """Whether ``piece`` can follow the piece ``last`` (or a fresh start)."""
        k = (last + 1) * len(self.piece) + self.id[piece]
        ok = self.pairs.get(k)
        if ok is None:
            before = [] if last == START else [self.piece[last]]
            ok = self.pairs[k] = self.encode("".join(before) + piece) == [*before, piece]
        return ok

    def step(self, key, ch: str):
        if ch == " " or ch == SPACE:
            if isinstance(key, int):
                k = key + 1
                first, period = self.cycle
                return self.state(k if k < first + period else k - period), self.run[k] - self.run[key]
            return self.state(1), self.run[1]
        if ch not in self.score:
            return self.state(("", ((0, START, 0),))), len(ch.encode("utf-8", "surrogatepass"))
        if isinstance(key, int):  # the last space of a run is its own token or part of the next
            back = self.run[key - 1] - self.run[key]
            key = (SPACE, ((1, START, back), (0, self.id[SPACE], 0)))
        held, entries = key
        found = [(text, count + 1) for off, last, count in entries
                 for text in [held[len(held) - off:] + ch] if text in self.words and self.fits(last, text)]
        if len(found) != 1:
            raise ValueError(f"no single encoding after {held + ch!r}")
        piece, now = found[0]
        kept = [(off + 1, last, count - now) for off, last, count in entries
                if held[len(held) - off:] + ch in self.open]
        held = (held + ch)[len(held) + 1 - kept[0][0]:] if kept else ""
        return self.state((held, (*kept, (0, self.id[piece], 0)))), now

    @property
    def initial(self) -> State:
        """The state after the space that the model puts before a text; it counts one token."""
        return self.state(1)

    def read(self, state: State, text: str) -> tuple[State, int]:
        n = 0
        for ch in text:
            state, emitted = state[ch]
            n += emitted
        return state, n

    def count(self, text: str) -> int:
        """Tokens of a whole text, a word at a time: each starts in the same state."""
        if not text:
            return 0
        if len(self.states) > self.max_states:  # the words read so far stay
            self.states, self.pairs = {}, {}
        return sum(map(self.words_read.__getitem__, WORD.findall(SPACE + text.replace(" ", SPACE))))

    def entries(self, context: str) -> list[State]:
        """States a text that goes on after ``context`` may be in.

        A space after another character fixes the state; without one in the
        context, the states reached from a fresh start at each of its
        characters are the candidates.
        """
        text = context.replace(" ", SPACE)
        for i in range(1, len(text)):
            if text[i] == SPACE and text[i - 1] != SPACE:
                return [self.read(self.state(1), text[i + 1:])[0]]
        fresh = ("", ((0, START, 0),))
        return list({s.key: s for i in range(len(text) + 1) for s in [self.read(self.state(fresh), text[i:])[0]]}.values())
