"""Token counts by a finite-state transducer compiled from a word-ended BPE vocabulary.

A word is a run of letters: one per byte, the last one marked as final.  Reading a word left to right, the encoding of
every prefix is the encoding of a shorter prefix plus one last token, and that token is the one suffix token that may
stand after the last token of the shorter prefix (no merge of lower rank crosses the border).  So a state holds the
longest suffix read that begins some token, and for each position in it the last token there and the count relative to
the present one.  That is finite, deterministic, and every transition is annotated with the tokens it emits (a later
letter may take tokens back, so an annotation may be negative).  Transitions are compiled when first taken and kept
in a table that is emptied between words when it has grown large; within a word it is bounded by the automaton alone.

A chunk of letters is a map of states: entry state to exit state and tokens emitted.  White space and the borders of pre-tokens
reset the transducer, so a chunk between them is a constant map (it starts and ends at the start state), and the scan over a
text's chunks is a running sum of memoised counts.  A pre-token of more than ``BLOCK`` letters is cut into blocks.  A block's map is worked out
from the start state without the blocks before it, and for another entry state by following that until it meets the
first run, which from there on holds for both (see ``StateMap``).  Maps compose pairwise, level by level; the composed map is applied to the
start state alone, so of each block's map only the entries that are met are worked out, from left to right within one task.

Edge cases: a null, empty or blank text has 0 tokens; special strings inside a text, in their own case only, count one each
and cut it, as the library does by default; repeated rows are counted one by one; a pre-token of any length is read in blocks; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import byte_letters
from .chunks import ChunkMemo
from .common import documents, id_text, lowered, per_worker, slices, word_spans

LIMIT = 2048
MAX_STATES = 120_000
MEMO_WORDS = 500_000
BLOCK = 4096


class CountTransducer:
    """Letters: code points 256 + byte inside a word, 512 + byte at its end."""

    def __init__(self, vocabulary: dict[str, int], merges: list, end: str = "</w>"):
        names = {c: b for b, c in enumerate(byte_letters())}
        self.letter = {}
        for name, token in vocabulary.items():
            if name in names:
                self.letter[chr(256 + names[name])] = token
            elif name.endswith(end) and name[: -len(end)] in names:
                self.letter[chr(512 + names[name[: -len(end)]])] = token
        spelled = {token: letter for letter, token in self.letter.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(merges):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, new = vocabulary[left], vocabulary[right], vocabulary[left + right]
            self.rank[a, b] = rank
            if new not in self.made and new not in spelled:
                self.made[new] = (rank, a, b)
            spelled.setdefault(new, spelled[a] + spelled[b])
        self.token = {text: token for token, text in spelled.items()}
        self.begins = {text[:n] for text in self.token for n in range(1, len(text) + 1)} | {""}
        self.fit: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        start = ("", (-1,), (0,))
        self.states = {start: 0}
        self.keys = [start]
        self.next: list[dict[str, tuple[int, int]]] = [{}]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart: undo their merges from the last one back, and look for a border merge that
        would have come before."""
        known = self.fit.get((left, right))
        if known is not None:
            return known
        key, bound, good = (left, right), float("inf"), True
        while True:
            border = self.rank.get((left, right))
            if border is not None and border < bound:
                good = False
                break
            from_left, from_right = self.made.get(left), self.made.get(right)
            if from_left is None and from_right is None:
                break
            if from_left is None or from_right is not None and from_right[0] >= from_left[0]:
                bound, right = from_right[0] + 1, from_right[1]
            else:
                bound, left = from_left[0], from_left[2]
        if len(self.fit) > 4 * MAX_STATES:
            self.fit.clear()
        self.fit[key] = good
        return good

    def compile(self, state: int, letter: str) -> tuple[int, int]:
        """The transition from a state on a letter: next state, tokens emitted."""
        seen, last, count = self.keys[state]
        text = seen + letter
        for size in range(len(text), 0, -1):
            token = self.token.get(text[-size:])
            if token is None:
                continue
            before = last[len(text) - size]
            if before == -1 or self.fits(before, token):
                break
        else:
            raise ValueError("no token ends here")
        emitted = count[len(text) - size] + 1
        last, count = (*last, token), (*count, emitted)
        while text not in self.begins:
            text = text[1:]
        last, count = last[-len(text) - 1 :], tuple(c - emitted for c in count[-len(text) - 1 :])
        key = (text, last, count)
        new = self.states.get(key)
        if new is None:
            new = self.states[key] = len(self.keys)
            self.keys.append(key)
            self.next.append({})
        self.next[state][letter] = (new, emitted)
        return new, emitted

    def count(self, word: str) -> int:
        """Tokens of one pre-token."""
        raw = word.encode()
        if not raw:
            return 0
        if len(self.keys) > MAX_STATES:
            self.reset()
        letters = raw[:-1].decode("latin-1").translate(_INSIDE) + chr(512 + raw[-1])
        if len(letters) > BLOCK:
            return self.scanned(letters)
        state = total = 0
        for letter in letters:
            step = self.next[state].get(letter)
            state, emitted = step if step is not None else self.compile(state, letter)
            total += emitted
        return total

    def scanned(self, letters: str) -> int:
        """Tokens of a long pre-token: maps of its blocks, equal blocks sharing one, composed pairwise."""
        blocks = [letters[k : k + BLOCK] for k in range(0, len(letters), BLOCK)]
        known = {b: StateMap(self, b) for b in set(blocks)}
        maps = [known[b].apply for b in blocks]
        while len(maps) > 1:
            maps = [composed(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return maps[0](0)[1]


class StateMap:
    """What a block of letters does to an entry state: the exit state and the tokens emitted."""

    def __init__(self, machine: CountTransducer, letters: str):
        self.machine, self.letters = machine, letters
        self.states, self.totals = [], []
        self.known = {0: self.run(0)}

    def run(self, state: int) -> tuple[int, int]:
        """Letter by letter; the first run, from the start state, is kept for the others to join."""
        total, first = 0, not self.states
        for k, letter in enumerate(self.letters):
            step = self.machine.next[state].get(letter)
            state, emitted = step if step is not None else self.machine.compile(state, letter)
            total += emitted
            if first:
                self.states.append(state)
                self.totals.append(total)
            elif state == self.states[k]:
                return self.states[-1], total + self.totals[-1] - self.totals[k]
        return state, total

    def apply(self, state: int) -> tuple[int, int]:
        if state not in self.known:
            self.known[state] = self.run(state)
        return self.known[state]


def composed(first, second):
    """The map of two stretches of blocks, one behind the other."""

    def apply(state: int) -> tuple[int, int]:
        middle, one = first(state)
        end, two = second(middle)
        return end, one + two

    return apply


_INSIDE = {b: 256 + b for b in range(256)}


class TextCounter:
    """Normalisation, chunks and their memo around the transducer."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.machine = CountTransducer(spec["model"]["vocab"], spec["model"]["merges"])
        self.find = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]))
        self.words: dict[str, int] = {}
        self.memo = ChunkMemo(self.learn)

    def word(self, word: str) -> int:
        if len(word) > BLOCK:
            return self.machine.count(word)
        n = self.words.get(word)
        if n is None:
            if len(self.words) >= MEMO_WORDS:
                self.words.clear()
            n = self.words[word] = self.machine.count(word)
        return n

    def part(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return sum(map(self.word, self.find(text.lower())))

    def text(self, text: str) -> int:
        """Tokens of any text or chunk of one."""
        if "<|" in text and (marks := len(self.special.findall(text))):
            return marks + sum(map(self.part, self.special.split(text)))
        return self.part(text)

    def learn(self, chunks: list[str], heads: list[bool]):
        return [self.text(c) for c in chunks], []

    def counts(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text of a slice: the sums of its chunks' maps."""
        low = lowered(buf)
        starts, ends, first = word_spans(low, offsets)
        # special strings are those of the raw text, so a chunk that may hold one keeps its case
        marks = np.flatnonzero((buf[:-1] == ord("<")) & (buf[1:] == ord("|")))
        for k in np.unique(np.searchsorted(starts, marks, side="right") - 1).tolist():
            low[starts[k] : ends[k]] = buf[starts[k] : ends[k]]
        _, size = self.memo.find(low, starts, ends, np.zeros(len(starts), dtype=bool))
        return np.diff(np.concatenate([[0], np.cumsum(size)])[first])


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""

    def run(batches):
        counter = per_worker(("counter", path), lambda: TextCounter(path))
        for batch in batches:
            for rows, buf, offsets in slices(batch, "text"):
                counts = counter.counts(buf, offsets)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.diff(offsets)), pa.array(counts.astype(np.int64)), pa.array(counts > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLE: dict[str, str] = {}
