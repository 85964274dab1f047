"""Operator 3: byte-pair encoding as a deterministic automaton over tokens.

The automaton begins with one state per base symbol, each with an arc for every base symbol. The merges are then applied
in order, each as a gadget on the states that exist so far. For the merge of u and v into w, with stamp r:

* the state after u loses its arc v (those two never stand side by side any more): cut[u, v] = r;
* a state after w is added, with the arcs that the state after v has at that moment: after[w] = v;
* every state with an arc u at that moment gets an arc w: enters[w] = u.

A path through the finished automaton is a correct tokenization and the other way round, so there is one path per word.
States share their arcs with the states that they were copied from, and an arc is looked up by going back through the
stamps; what was looked up stays in a table. A word is encoded by running a trie of arc labels over it: each prefix ends
in exactly one state. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetvane.llm.common import by_slices, held, raw_texts_of
from fleetvane.llm.tokens import MOST_BYTES, WordEncoder, packed, tokenizer_path

TOKENIZER = "word_bpe_49k.json"
NEVER = 1 << 40
#: Arcs that stay in the table of those looked up, some 150 bytes each.
MOST_ARCS = 400_000


class MergeAutomaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        """vocab and merges as in a BPE vocabulary file; suffix marks a word's last symbol. Each token must come from one merge or be a base symbol."""
        size = max(vocab.values()) + 1
        self.suffix, self.labels = suffix, [""] * size
        for label, i in vocab.items():
            self.labels[i] = label
        self.stamp, self.after, self.enters = [-1] * size, [-1] * size, [-1] * size
        self.cut: dict[tuple[int, int], int] = {}
        for r, (u, v) in enumerate(merges):
            self._gadget(r, vocab[u], vocab[v], vocab[u + v])
        self._arcs: dict[tuple[int, int], bool] = {}
        # A trie of the labels: a node's children by symbol, the label that ends there inside a word, and at a word's end.
        self.children: list[dict[str, int]] = [{}]
        self.inner, self.final = [-1], [-1]
        for label, i in vocab.items():
            last = suffix != "" and label.endswith(suffix) and label != suffix
            node = 0
            for symbol in label[: len(label) - len(suffix)] if last else label:
                if symbol not in self.children[node]:
                    self.children[node][symbol] = len(self.children)
                    self.children.append({})
                    self.inner.append(-1)
                    self.final.append(-1)
                node = self.children[node][symbol]
            if last:
                self.final[node] = i
            else:
                self.inner[node] = i
                if not suffix:
                    self.final[node] = i

    def _gadget(self, r: int, u: int, v: int, w: int) -> None:
        if self.stamp[w] >= 0:
            raise ValueError(f"two merges make the token {self.labels[w]!r}")
        self.cut[u, v] = r
        self.stamp[w], self.after[w], self.enters[w] = r, v, u

    def arc(self, p: int, q: int) -> bool:
        """Whether the state after p has an arc q."""
        known = self._arcs.get((p, q))
        if known is None:
            if len(self._arcs) >= MOST_ARCS:
                self._arcs.clear()
            known = self._arcs[p, q] = self._look_up(p, q)
        return known

    def _look_up(self, p: int, q: int) -> bool:
        stamp, until = self.stamp, NEVER
        while True:
            if self.cut.get((p, q), NEVER) < until:
                return False
            if stamp[p] > stamp[q]:
                p, until = self.after[p], stamp[p]  # the copy was made before the cuts of its own merge
            elif stamp[q] >= 0:
                q, until = self.enters[q], stamp[q] + 1  # where q could be entered after them
            else:
                return True

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-split word of base symbols; none of a word with an unknown symbol is dropped: KeyError."""
        n = len(word)
        state, back = [-1] * (n + 1), [0] * (n + 1)
        children, inner, final, arcs = self.children, self.inner, self.final, self._arcs
        for i in range(n):
            p = state[i]
            if i and p < 0:
                continue
            node = 0
            for j in range(i + 1, n + 1):
                node = children[node].get(word[j - 1], -1)
                if node < 0:
                    break
                q = inner[node] if j < n else final[node]
                if q >= 0 and state[j] < 0:
                    known = not i or arcs.get((p, q))
                    if known or known is None and self.arc(p, q):
                        state[j], back[j] = q, i
        ids = []
        while n:
            if state[n] < 0:
                raise KeyError(f"{word!r} has symbols that the vocabulary lacks")
            ids.append(state[n])
            n = back[n]
        return ids[::-1]


class AutomatonEncoder(WordEncoder):
    """A WordEncoder whose words go through the automaton; the library only normalizes and pre-splits what isn't plain text."""

    def __init__(self, path: str, most_bytes: int = MOST_BYTES):
        super().__init__(path, most_bytes)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.automaton = MergeAutomaton(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = [*self.automaton.labels]
        for label, i in self.special.items():
            self.labels += [""] * (i + 1 - len(self.labels))
            self.labels[i] = label
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _word(self, symbols: str) -> bytes:
        return packed(self.automaton.encode_word(symbols))

    def _special(self, text: str) -> bytes:
        parts = self.at_special.split(text) if self.at_special else [text]
        return b"".join(packed([self.special[p]]) if p in self.special else self._odd(p) for p in parts if p)

    def decode(self, ids: list[int]) -> str:
        """What the library's decode(ids, skip_special_tokens=False) gives: this vocabulary has no decoder, so labels are joined by a space."""
        return " ".join(map(self.labels.__getitem__, ids))


@held
def automaton_encoder(path: str) -> AutomatonEncoder:
    """One encoder for all tasks of a Python worker: the automaton is compiled once, and words that are known stay known."""
    return AutomatonEncoder(path)


def automaton_round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document's whole text; null texts are empty, with no ids.

    Rows are independent: repeated or null doc_ids are kept as they are, and other columns of docs play no part.
    """
    path = path or tokenizer_path(TOKENIZER)

    def make():
        encoder = automaton_encoder(path)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = encoder.encode(raw_texts_of(batch, "text"))
            shas = [hashlib.sha256(x).hexdigest() for x in ids]
            decoded = [hashlib.sha256(encoder.decode(np.frombuffer(x, "<u4").tolist()).encode("utf-8")).hexdigest() for x in ids]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return each

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(by_slices(256, make), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
