"""Byte-pair encoding and decoding by dynamic programming over prefixes.

For every prefix of a segment there is exactly one token that can end its encoding. An automaton over the vocabulary's
byte strings proposes the tokens that end there, the longest first. It is an Aho-Corasick automaton, that is the vocabulary's
trie with suffix links: it lists the same matches as a suffix automaton of the vocabulary would, without the factors that are
no tokens, and takes its place here. A proposal is right if it may follow the last token of the prefix before it, which a
test of the pair decides: undoing the merges along the boundary must never meet a pair that would have merged earlier. The
last tokens are stored and following them back gives the ids. No merge is ever simulated on the text.

Edge cases: null text counts as empty (no ids, empty decoded text); texts that spell the special token get its id; very
long segments cost time in proportion to their length; other columns are ignored; repeated rows give repeated results.
Ids that are not in the vocabulary decode to nothing, and bytes that are not UTF-8 to U+FFFD.
"""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, runs_of, short_batches
from .textvec import Scan, WordIds, split_bytes

RUN_CHARS = 1_000_000
#: Pairs whose test is remembered in a worker.
MEMO_PAIRS = 2_000_000


def byte_alphabet() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary file means."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class PrefixBPE:
    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        bytes_of = lambda s: bytes(alphabet[c] for c in s)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.id_of = {bytes_of(k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        size = 1 + max([*self.id_of.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for k, v in [*self.id_of.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.bytes_of[v] = k
        self.rank: dict[tuple[int, int], int] = {}  # of a pair that merges
        self.halves: dict[int, tuple[int, int]] = {}  # of a token, the pair that makes it
        self.made: dict[int, int] = {}  # the rank at which a token is made
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            a, b = bytes_of(a), bytes_of(b)
            pair, whole = (self.id_of[a], self.id_of[b]), self.id_of[a + b]
            self.rank.setdefault(pair, r)
            if whole not in self.halves:
                self.halves[whole], self.made[whole] = pair, r
        self.automaton = ahocorasick.Automaton()
        for k, v in self.id_of.items():
            if v not in self.halves or self.reachable(v):  # others never occur: their own merges lead elsewhere
                self.automaton.add_word(k.decode("latin-1"), (len(k), v))
        self.automaton.make_automaton()
        self.memo: dict[int, bool] = {}
        self.cache = WordIds(lambda words: list(map(self.encode_segment, words)), limit=600_000)

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``right`` can follow ``left``: no merge across their boundary, at any depth of either, comes before
        the merges that build the two up to there.

        The walk splits the younger of the two boundary tokens again and again. ``bound`` is the rank from which on a
        merge across the boundary comes too late, because a side has been joined to what lies beyond it by then; equal
        ranks are settled from left to right."""
        key = left << 20 | right
        got = self.memo.get(key)
        if got is not None:
            return got
        rank, made, halves = self.rank, self.made, self.halves
        a, b = left, right
        bound, ties = 1 << 60, False
        out = True
        while True:
            r = rank.get((a, b))
            if r is not None and (r < bound or (r == bound and ties)):
                out = False
                break
            ra, rb = made.get(a, -1), made.get(b, -1)
            if ra < 0 and rb < 0:
                break
            if ra > rb:  # the left one was joined last: before that its right half stood at the boundary
                bound, ties = ra, False
                a = halves[a][1]
            else:  # the right one was joined last (or at the same merge, where the left one came first)
                bound, ties = rb, True
                b = halves[b][0]
        if len(self.memo) >= MEMO_PAIRS:
            self.memo.clear()
        self.memo[key] = out
        return out

    def encode_segment(self, text: str) -> list[int]:
        data = text.encode()
        n = len(data)
        last, size = [-1] * n, [0] * n
        compatible = self.compatible
        for end, (k, token) in self.automaton.iter(data.decode("latin-1")):
            if last[end] >= 0:
                continue
            before = end - k
            if before < 0 or compatible(last[before], token):
                last[end], size[end] = token, k
        out, at = [], n - 1
        while at >= 0:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def reachable(self, token: int) -> bool:
        """Whether the merges do arrive at this token from its bytes: its halves must be compatible but for this merge."""
        a, b = self.halves[token]
        r = self.made[token]
        bound, ties, first = 1 << 60, False, True
        rank, made, halves = self.rank, self.made, self.halves
        while True:
            x = rank.get((a, b))
            if not first and x is not None and (x < bound or (x == bound and ties)):
                return False
            first = False
            ra, rb = made.get(a, -1), made.get(b, -1)
            if max(ra, rb) > r:
                return False
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                bound, ties, a = ra, False, halves[a][1]
            else:
                bound, ties, b = rb, True, halves[b][0]

    def encode(self, texts: list[str]):
        """Yield one uint32 array for each text."""
        for i, j in runs_of(texts, RUN_CHARS):
            plain = [t if not any(s in t for s in self.special) else None for t in texts[i:j]]
            s = Scan([t or "" for t in plain])
            ids, at = self.cache.ids(s, *split_bytes(s))
            for k in range(j - i):
                yield ids[at[k] : at[k + 1]] if plain[k] is not None else self._around_special(texts[i + k])

    def _around_special(self, text: str) -> np.ndarray:
        import re

        parts = re.split("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")", text)
        plain = iter(list(self.encode(parts[::2])))
        out = []
        for k, x in enumerate(parts):
            out.append(np.array([self.special[x]], np.uint32) if k % 2 else next(plain))
        return np.concatenate(out)

    def decode(self, ids: np.ndarray) -> str:
        table = self.bytes_of
        n = len(table)
        return b"".join([table[i] for i in ids.tolist() if i < n]).decode("utf-8", "replace")


@functools.cache
def coder(path: str) -> PrefixBPE:
    return PrefixBPE(path)


def encode_documents(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded text; with ``with_ids`` also the ids and the decoded text."""
    short_batches(docs.sparkSession)

    def run(batches):
        c = coder(vocabulary)
        for b in batches:
            texts = [x or "" for x in b.column("text").to_pylist()]
            n, ids_sha, text_sha, all_ids, all_text = [], [], [], [], []
            for ids in c.encode(texts):
                text = c.decode(ids)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(text.encode()).hexdigest())
                if with_ids:
                    all_ids.append(ids.astype(np.int64))
                    all_text.append(text)
            cols = {"doc_id": b.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
            if with_ids:
                cols |= {"ids": pa.array(all_ids, pa.list_(pa.int64())), "decoded": pa.array(all_text, pa.string())}
            yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op3_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Every whole text, encoded and decoded again."""
    import public_tokenizers

    return encode_documents(documents(spark, sf_dir), vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
