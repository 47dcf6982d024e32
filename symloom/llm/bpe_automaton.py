"""BPE encoding and decoding with a tokenization automaton.

The merges are compiled, one merge gadget after the other, into a deterministic automaton over
token labels that accepts exactly the correct token sequences of words. All arcs with the same
label lead to the same state, so a state is named by a label. The gadget of merge number ``k``,
``(x, y)``, gives the state behind ``x`` a copy of its own without the arc ``y``, and adds the arc
``xy`` wherever ``x`` then ``y`` could be taken. Rows of the transition table are kept as what a
gadget took away: ``(x, y) -> k``. A label's row is that of its right part at the time of its own
gadget, and an arc is present where its left part was at the time of its gadget, which walks over
the two spines tell. The whole table of a vocabulary of 49,000 labels has 2.4 billion arcs, so arcs
are read off these rows.

Words are read letter by letter. Every beginning of a word has exactly one accepted sequence, so
after each letter one label is the last one of the word so far, and what matters for the letters
to come are the labels that have begun and the label that each of them would follow. Such
situations are the states of a deterministic automaton over letters; its transition table is filled
as words need it and says the next state and the label that ends there. A word takes one look-up a
letter, without search or steps back, and its labels are read from its end by their lengths.
Decoding emits arc labels.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import holds
from symloom.llm.wordsplit import CHUNKS, SPECIAL, WORDS, ChunkCache, is_plain, letters

END = "</w>"
#: Transitions kept before a table starts anew; this bounds memory, not results.
TRANSITIONS = 1 << 18
#: The part of a transition that is its label.
LABEL_BITS, LABELS = 32, (1 << 32) - 1
START = -1
NEVER = 1 << 60
#: Key of a node's own number in the tree of letters, whose other keys are letters.
NUMBER = 0


class MergeAutomaton:
    """The automaton of a list of merges over base labels ``0 .. base-1``.

    ``merges`` holds (left label, right label, new label). Merges whose two sides can never stand
    side by side make labels without arcs (``dead``).
    """

    def __init__(self, merges: Sequence[tuple[int, int, int]]):
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.born: dict[int, int] = {}
        self.taken: dict[tuple[int, int], int] = {}
        self.dead: set[int] = set()
        self.table: dict[tuple[int, int], bool] = {}
        for k, (x, y, new) in enumerate(merges):
            self._gadget(k, x, y, new)

    def _gadget(self, k: int, x: int, y: int, new: int) -> None:
        if x in self.dead or y in self.dead or not self._arc(x, y):
            self.dead.add(new)
        else:
            self.taken[x, y] = k
        self.left[new], self.right[new], self.born[new] = x, y, k

    def _arc(self, u: int, v: int) -> bool:
        """Whether the state behind ``u`` has an arc ``v``."""
        taken, left, right, born = self.taken, self.left, self.right, self.born
        x, since = u, NEVER
        while True:
            y, until = v, NEVER
            while True:
                k = taken.get((x, y))
                # a gadget takes its arc away first, copies it under the new label then
                if k is not None and k < since and k <= until:
                    return False
                if y not in born:
                    break
                until = born[y]
                y = left[y]
            if x not in born:
                return True
            since = born[x]
            x = right[x]

    def step(self, u: int, v: int) -> bool:
        """The table's entry for arc ``v`` in the state behind ``u``."""
        key = (u, v)
        found = self.table.get(key)
        if found is None:
            if len(self.table) > TRANSITIONS:
                self.table.clear()
            found = self.table[key] = self._arc(u, v)
        return found


def symbols(mapped: str) -> list[str]:
    """A word's letters, the last one marked, as the end belongs to it."""
    return [*mapped[:-1], mapped[-1] + "\n"] if mapped else []


class WordBpe:
    """A vocabulary file with word ends, compiled: words to ids and ids to labels."""

    def __init__(self, path: str, held: int = WORDS):
        self.most = held  # words in the cache's young half, and transitions
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab: dict[str, int] = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.automaton = MergeAutomaton([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        self.labels = {i: t for t, i in vocab.items()}
        self.special = {a["content"]: a["id"] for a in self._added(path)}
        self.labels.update({i: t for t, i in self.special.items()})
        # live labels as a tree of letters, a word's last letter with its end; "" holds a label's
        # id, NUMBER the node's place in the list
        self.nodes: list[dict] = [{NUMBER: 0}]
        self.length = [0] * (max(self.labels, default=-1) + 1)
        for t, i in vocab.items():
            if i not in self.automaton.dead:
                node = self.nodes[0]
                for c in (own := symbols(t[: -len(END)]) if t.endswith(END) else list(t)):
                    if c not in node:
                        node[c] = {NUMBER: len(self.nodes)}
                        self.nodes.append(node[c])
                    node = node[c]
                node[""] = i
                self.length[i] = len(own)
        self._restart()
        self.text = [f"{i}" for i in range(max(self.labels, default=-1) + 1)]
        self._tokenizer, self.path = None, path
        self.cache = ChunkCache(lambda w: self._value(self.word(letters(w))), self._joined, min(CHUNKS, held), held)

    @staticmethod
    def _added(path: str) -> list[dict]:
        with open(path, encoding="utf-8") as f:
            return json.load(f)["added_tokens"]

    def _restart(self) -> None:
        # a state is what has begun: label before and number in the tree of letters of each label,
        # flat, as there are many states
        self.begun: list[tuple[int, ...]] = []
        self.known: dict[tuple[int, ...], int] = {}
        # a transition is one number: the next state above, the label that ends below
        self.rows: list[dict[str, int]] = []
        self.n_transitions = 0
        self._state((START, 0))

    def _state(self, begun: tuple[int, ...]) -> int:
        state = self.known.get(begun)
        if state is None:
            state = self.known[begun] = len(self.rows)
            self.begun.append(begun)
            self.rows.append({})
        return state

    def _advance(self, state: int, letter: str) -> int:
        """A new transition: the next state, and the label that ends with this letter."""
        step, nodes, begun, ended = self.automaton.step, self.nodes, [], None
        old = self.begun[state]
        for u, number in zip(old[::2], old[1::2], strict=True):
            node = nodes[number].get(letter)
            if node is None:
                continue
            label = node.get("")
            if label is not None and ended is None and (u == START or step(u, label)):
                ended = label
            if len(node) > 1 + (label is not None):  # some label goes on
                begun += (u, node[NUMBER])
        if ended is None:
            raise ValueError(f"no accepted sequence with {letter!r}")
        begun += (ended, 0)
        found = self.rows[state][letter] = self._state(tuple(begun)) << LABEL_BITS | ended
        self.n_transitions += 1
        return found

    def word(self, mapped: str) -> list[int]:
        """Ids of one word, given as byte letters: one transition a letter."""
        if self.n_transitions > self.most:
            self._restart()
        rows, state, ends = self.rows, 0, []
        for c in symbols(mapped):
            row = rows[state]
            found = row[c] if c in row else self._advance(state, c)
            state = found >> LABEL_BITS
            ends.append(found)
        path, at, length = [], len(ends), self.length
        while at:
            label = ends[at - 1] & LABELS
            path.append(label)
            at -= length[label]
        path.reverse()
        return path

    def _value(self, ids: list[int]) -> tuple[str, str, int]:
        text, labels = self.text, self.labels
        return " ".join([text[i] for i in ids]), " ".join([labels[i] for i in ids]), len(ids)

    @staticmethod
    def _joined(values: list[tuple[str, str, int]]) -> tuple[str, str, int]:
        return " ".join([v[0] for v in values]), " ".join([v[1] for v in values]), sum([v[2] for v in values])

    def _odd(self, text: str) -> list[tuple[str, str, int]]:
        """Texts beyond the plain characters: the library's normalizer and word cutter, our ids."""
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
        out = []
        for piece in SPECIAL.split(text):
            if piece in self.special:
                out.append((self.text[i := self.special[piece]], self.labels[i], 1))
            elif piece:
                normal = self._tokenizer.normalizer.normalize_str(piece)
                words = [self.word(w) for w, _ in self._tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
                out.append(self._value([i for w in words for i in w]))
        return [x for x in out if x[2]]

    def coded(self, text: str) -> tuple[str, str, int]:
        """Decimal ids, labels (both joined by one space) and number of ids of a whole text."""
        values = self.cache.values(text) if is_plain(text) else self._odd(text)
        return self._joined(values)

    def encode(self, text: str) -> list[int]:
        ids = self.coded(text)[0]
        return [int(i) for i in ids.split(" ")] if ids else []

    def decode(self, ids: Iterable[int]) -> str:
        """Arc labels of ids, special ones too; ids that the automaton lacks emit nothing."""
        return " ".join([self.labels[i] for i in ids if i in self.labels])


@lru_cache(maxsize=1)
def compiled(path: str, held: int = WORDS) -> WordBpe:
    """The compiled vocabulary of this process; its caches hold about ``held`` words twice."""
    return WordBpe(path, held)


def bpe_encode(text: Column, path: str) -> Column:
    """Ids of whole texts as array<int>; null texts give an empty array."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        holds("bpe", compiled.cache_clear)
        bpe = compiled(path)
        return pa.array([bpe.encode(t or "") for t in texts.to_pylist()], pa.list_(pa.int32()))

    return encode(text)


def bpe_decode(ids: Column, path: str) -> Column:
    """Labels of ids joined by one space; null or empty arrays give the empty text."""

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        holds("bpe", compiled.cache_clear)
        bpe = compiled(path)
        return pa.array([bpe.decode(r or ()) for r in rows.to_pylist()], pa.string())

    return decode(ids)


def bpe_digests(text: Column, path: str, held: int = WORDS) -> Column:
    """Struct (n_tokens, ids_sha256, decoded_sha256) of whole texts, encoded and decoded again."""

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pa.Array) -> pa.Array:
        holds("bpe", compiled.cache_clear)
        bpe = compiled(path, held)
        n, ids, decoded = [], [], []
        for t in texts:
            own, labels, k = bpe.coded(t.as_py() or "")
            n.append(k)
            ids.append(hashlib.sha256(own.encode()).hexdigest())
            decoded.append(hashlib.sha256(labels.encode()).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests(text)


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document.

    One row per row, repeated rows too. Null and empty texts have no ids: 0 and the digests of
    the empty text. Further columns are left out, whatever their names; an empty table gives an
    empty one. No shuffle; memory is one Arrow batch and the bounded caches of a worker.
    """
    return docs.select("doc_id", bpe_digests(F.col("text"), path).alias("r")).select("doc_id", "r.*")
