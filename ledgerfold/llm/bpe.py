"""Byte-level BPE by longest matches and adjacent-token compatibility.

A text is cut by the vocabulary's pattern and each stretch is encoded on its
own. The bytes of a stretch are read as Latin-1 characters, over which an
Aho-Corasick automaton of all tokens finds the longest token starting at each
place. Encoding goes forward with the longest match and backtracks to a shorter
token whenever a neighbour isn't compatible: two tokens may stand side by side
exactly if merging their concatenation by rank gives back those two. That
verdict is remembered per pair, and dead positions are never entered twice, so
the work is linear in the stretch. The result is what merging by rank gives.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

from pyspark.sql import DataFrame

from ledgerfold.llm._common import map_rows

#: Stretches, and pairs of tokens, that a Python worker remembers before it starts afresh.
CACHE_STRETCHES = 300_000
CACHE_PAIRS = 500_000


def load_ranks(path: str) -> dict[bytes, int]:
    """A ``.tiktoken`` file: base64 of a token's bytes and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class BacktrackingBpe:
    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.length = {rank: len(token) for token, rank in ranks.items()}
        # Tokens are reversed, so that an end found in reversed bytes is a token's start.
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token[::-1].decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.split = {rank: self._halves(token) for token, rank in ranks.items() if len(token) > 1}
        self.shorter = {rank: self._shorter(token) for token, rank in ranks.items()}
        self.pairs: dict[int, bool] = {}

    def _shorter(self, token: bytes) -> int | None:
        for end in range(len(token) - 1, 0, -1):
            if (rank := self.ranks.get(token[:end])) is not None:
                return rank
        return None

    def _halves(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge is ``token``: what merging its bytes by lower ranks leaves."""
        limit = self.ranks[token]
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = limit, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1], limit)
                if rank < best:
                    best, at = rank, i
            if at < 0:
                return None  # no sequence of merges makes it
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens ``a`` and ``b`` stay as they are when side by side."""
        key = a << 32 | b
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # Undo the later merge on either side, step by step. A merge across the
        # seam that would have come before the one just undone breaks the pair;
        # of equal ranks the one further left comes first, so the seam beats an
        # equal merge on its right but not one on its left.
        ranks, tokens, split = self.ranks, self.tokens, self.split
        limit = 1 << 62
        while True:
            across = ranks.get(tokens[a] + tokens[b])
            if across is not None and across < limit:
                return False
            left, right = split.get(a), split.get(b)
            if left and (a > b or not right):
                limit, a = a, left[1]
            elif right:
                limit, b = b + 1, right[0]
            else:
                return True

    def longest_matches(self, data: bytes) -> list[int]:
        """The longest token that starts at each place, last place first."""
        out, last = [], -1
        for end, rank in self.automaton.iter(data[::-1].decode("latin-1")):
            if end != last:  # of matches with one end the longest comes first
                out.append(rank)
                last = end
        return out

    def encode(self, data: bytes) -> list[int]:
        if (rank := self.ranks.get(data)) is not None and (len(data) == 1 or self.split[rank]):
            return [rank]
        n, at, out = len(data), 0, []
        if not n:
            return out
        longest = self.longest_matches(data)
        length, pairs, compatible, shorter = self.length, self.pairs, self.compatible, self.shorter
        dead = bytearray(n + 1)
        token = longest[-1]
        before = -1
        while True:
            end = at + length[token]
            if not dead[end]:
                if before < 0:
                    fits = True
                elif (fits := pairs.get(before << 32 | token)) is None:
                    fits = compatible(before, token)
                if fits:
                    out.append(token)
                    if end == n:
                        return out
                    before, at = token, end
                    token = longest[n - 1 - at]
                    continue
            if (less := shorter[token]) is not None:
                token = less
                continue
            # Nothing that starts here goes on: step back one token and shorten it.
            dead[at] = 1
            token = out.pop()
            at -= length[token]
            before = out[-1] if out else -1

    def decode(self, ids) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


@lru_cache(maxsize=2)
def encoder_of(path: str) -> BacktrackingBpe:
    return BacktrackingBpe(load_ranks(path))


def encode_text(bpe: BacktrackingBpe, find, known: dict[str, bytes], text: str) -> bytes:
    """Ids of ``text`` as little-endian uint32 bytes."""
    import numpy as np

    parts = find(text)
    for part in set(parts):
        if part not in known:
            known[part] = np.array(bpe.encode(part.encode("utf-8", "surrogatepass")), dtype="<u4").tobytes()
    out = b"".join([known[p] for p in parts])
    if len(known) > CACHE_STRETCHES:
        known.clear()
    return out


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encodes every text of ``docs`` (doc_id, text) and decodes the ids again.

    Returns doc_id, n_tokens, ids_sha256 (of little-endian uint32 ids) and
    decoded_sha256. A null or empty text has no ids; both digests are then those
    of no bytes. Rows are independent: repeated rows give repeated results, and
    further columns are ignored.
    """

    def start():
        import numpy as np
        import regex

        bpe, find, known = encoder_of(ranks_path), regex.compile(pattern).findall, {}
        table = np.array([bpe.tokens[i] for i in range(len(bpe.tokens))], dtype=object) if set(bpe.tokens) == set(range(len(bpe.tokens))) else None

        def row(doc_id, text):
            ids = encode_text(bpe, find, known, text or "")
            numbers = np.frombuffer(ids, dtype="<u4")
            decoded = b"".join(table[numbers].tolist()) if table is not None else bpe.decode(numbers.tolist())
            yield doc_id, len(numbers), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()

        return row

    return map_rows(docs.select("doc_id", "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", start)
