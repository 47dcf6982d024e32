from __future__ import annotations

import hashlib
import itertools
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from symloom.llm import bpe_automaton as B
from symloom.llm import wordsplit as W
from symloom.llm.bpe_automaton import MergeAutomaton, bpe_decode, bpe_encode, bpe_round_trip, compiled
from symloom.llm.wordsplit import ChunkCache

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def apply_merges(symbols, merges):
    """Merges in order of rank, each from left to right: what the automaton has to accept."""
    out = list(symbols)
    for x, y, new in merges:
        i = 0
        while i + 1 < len(out):
            if out[i] == x and out[i + 1] == y:
                out[i : i + 2] = [new]
            i += 1
    return out


@pytest.mark.parametrize("seed", range(30))
def test_automaton_accepts_exactly_the_merged_sequences(seed):
    rnd = random.Random(seed)
    merges, known, spelled = [], [0, 1], {0: (0,), 1: (1,)}
    while len(merges) < 7:
        x, y = rnd.choice(known), rnd.choice(known)
        if spelled[x] + spelled[y] in spelled.values():
            continue
        new = len(known)
        spelled[new] = spelled[x] + spelled[y]
        merges.append((x, y, new))
        known.append(new)
    automaton = MergeAutomaton(merges)
    for n in range(1, 9):
        for word in itertools.product((0, 1), repeat=n):
            want = apply_merges(word, merges)
            found, todo = [], [((), 0)]
            while todo:
                path, at = todo.pop()
                if at == n:
                    found.append(list(path))
                for label in known:
                    s = spelled[label]
                    if label not in automaton.dead and word[at : at + len(s)] == s and (not path or automaton.step(path[-1], label)):
                        todo.append(((*path, label), at + len(s)))
            assert found == [want]


def test_same_as_the_library(library):
    bpe, rnd = compiled(PATH), random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCÉÀßçñÿİſΣσς'' \t\n0123<|>.!?_-́é\x85\xa0\x1c 　日本語😀²½ªDžΩ"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    texts += [t[:9] + "<|endoftext|>" + t[9:] for t in texts[:200]] + [c * n for c in "aehl'" for n in range(1, 50)]
    texts += [f"a{chr(c)}b 's{chr(c)}" for c in range(0x300)] + ["", " ", "<|endoftext|><|startoftext|>"]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert bpe.encode(t) == ids
        assert bpe.coded(t)[1] == library.decode(ids, skip_special_tokens=False) == bpe.decode(ids)


def test_caches_start_anew():
    cache = ChunkCache(str.upper, "".join, chunks=3, words=2)
    text = "a b c d e f g a b it's"
    for _ in range(5):
        assert cache.values(text) == ["A", "B", "C", "D", "E", "F", "G", "A", "B", "IT'S"]
    assert len(cache.chunks) + len(cache.chunks.old) < 30


def test_round_trip(docs, rows, empty, library):
    got = sorted(map(tuple, bpe_round_trip(docs, PATH).collect()), key=str)
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str)
    assert bpe_round_trip(empty, PATH).collect() == []


def test_columns(docs, library):
    got = docs.select("text", bpe_encode(docs["text"], PATH).alias("ids"))
    got = got.select("text", "ids", bpe_decode(got["ids"], PATH).alias("back")).collect()
    for r in got:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["back"] == library.decode(ids, skip_special_tokens=False)


def test_transitions_are_numbers_and_ascii_stands_for_itself():
    bpe = B.WordBpe(PATH, 50)  # the table starts anew often
    words = ["whither", "unbelievably", "x9", "...!?", "café", "\x7f~"]
    assert [bpe.decode(bpe.word(W.letters(w))).replace(" ", "") for w in words[:2]] == ["whither</w>", "unbelievably</w>"]
    assert all(isinstance(x, int) for row in bpe.rows for x in row.values())
    for w in words:
        assert W.letters(w) == "".join(W.BYTE_LETTERS[b] for b in w.encode())
