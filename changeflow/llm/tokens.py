"""Token counts of a byte-level BPE vocabulary, by dynamic programming over prefixes.

For every prefix of a text the table holds how many tokens it encodes to. A prefix of a piece ends in the one vocabulary
token that may follow the last token of what stands before it: two tokens may stand side by side if encoding their
joined bytes gives the two back. So each prefix needs one look at the tokens that end there, and its count is one more
than that of the prefix before. Pieces are what the vocabulary's pattern cuts a text into; counts add up over pieces, and
a piece's table is remembered for the next text that has it. From the table, the count of a prefix, and the longest
prefix within a budget, are read without encoding anything again.

Results in odd cases: NULL counts as the empty text, with 0 bytes and tokens. Special tokens of the vocabulary inside a text
are one token each, as the vocabulary's library has it by default. Very long texts are worked through in slices that end
where a piece must end. Repeated rows each get their row; further input columns are ignored.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from changeflow.llm.shared import Memo

#: How byte-level vocabularies of this kind cut a text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a text that are cut into pieces at once.
SLICE = 1 << 20
LIMIT = 1024
#: Pieces, and pairs of tokens, that a worker remembers.
PIECES = 1_000_000
#: From this character on, libraries may know different versions of the character tables.
NEWER = "\u0530"


def _alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(other)}


class PrefixCounts:
    """The vocabulary, and what it has given for recent pieces."""

    def __init__(self, vocabulary: str):
        content = json.loads(vocabulary)
        places = _alphabet()
        raw = lambda x: bytes(map(places.__getitem__, x))
        self.tokens = {raw(x) for x in content["model"]["vocab"] if all(c in places for c in x)}
        pairs = (x.split(" ") if isinstance(x, str) else x for x in content["model"]["merges"])
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.halves = {a + b: (a, b) for a, b in self.ranks}
        self.made = {a + b: i for (a, b), i in self.ranks.items()}
        self.longest = max(map(len, self.tokens))
        self.special = [x["content"] for x in content["added_tokens"] if x["special"]]
        self.fast_cut, self.exotic = regex.compile(PATTERN).findall, regex.compile(f"[{NEWER}-\U0010ffff]").search
        self.slow_cut = ByteLevel(add_prefix_space=False).pre_tokenize_str
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.follows = Memo(lambda pair: self.stays(*pair), PIECES)
        # Tokens that no text encodes to are left out.
        self.tokens = {x for x in self.tokens if x not in self.halves or self.stays(*self.halves[x], self.made[x])}
        self.of_piece = Memo(lambda piece: self.table(piece.encode())[-1], PIECES)

    def cut(self, text: str) -> list[str]:
        """The pieces; where the two libraries' character tables may differ, as the vocabulary's library cuts."""
        if text.isascii() or not self.exotic(text):
            return self.fast_cut(text)
        return [text[a:b] for _, (a, b) in self.slow_cut(text)]

    def stays(self, left: bytes, right: bytes, below: int = 1 << 60) -> bool:
        """Whether no merge of a rank under `below` joins bytes across the border before the two tokens are made.

        The younger of the two is taken apart at the border, as merges are done in order of rank; of equally young ones
        the left is made first.
        """
        while True:
            if self.ranks.get((left, right), 1 << 60) < below:
                return False
            young, old = self.made.get(left, -1), self.made.get(right, -1)
            if young > old:
                below, left = young, self.halves[left][1]
            elif old >= 0:
                below, right = old + 1, self.halves[right][0]
            else:
                return True

    def table(self, data: bytes) -> list[int]:
        """Token counts of all prefixes of one piece, from the empty one on."""
        counts, last, tokens, follows = [0], [b""], self.tokens, self.follows
        for end in range(1, len(data) + 1):
            for start in range(max(0, end - self.longest), end):
                token = data[start:end]
                if token in tokens and (not start or follows[last[start], token]):
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary has no token for a byte")
        return counts

    def parts(self, text: str) -> Iterator[tuple[bool, str]]:
        """Special tokens, and slices of the text between them that end where a piece ends."""
        at = 0
        for mark in self.marks.finditer(text) if self.marks else ():
            yield from self.slices(text[at : mark.start()])
            yield True, mark.group()
            at = mark.end()
        yield from self.slices(text[at:] if at else text)

    @staticmethod
    def slices(text: str) -> Iterator[tuple[bool, str]]:
        start = 0
        while len(text) - start > SLICE:
            end = start + SLICE
            while end < len(text) and not (text[end] == " " and not text[end - 1].isspace()):
                end += 1
            yield False, text[start:end]
            start = end
        if start < len(text):
            yield False, text[start:] if start else text

    def steps(self, text: str) -> Iterator[tuple[list[str], np.ndarray]]:
        """Pieces in order, with each one's token count."""
        for special, part in self.parts(text):
            found = [part] if special else self.cut(part)
            yield found, np.ones(1, np.int64) if special else np.fromiter(map(self.of_piece.__getitem__, found), np.int64, len(found))

    def count(self, text: str) -> int:
        return sum(int(counts.sum()) for _, counts in self.steps(text))

    def prefixes(self, text: str) -> np.ndarray:
        """Token counts of all prefixes in characters, from the empty one to the whole text."""
        out, before, gap, piece, own = [np.zeros(1, np.int64)], 0, "", "", [0]
        for special, part in self.parts(text):
            if special:
                # Until it is complete, a special token's string is ordinary text, which may join the piece before it.
                out.append(np.array([before - own[-1] + self.count(piece + part[:i]) for i in range(1, len(part))] + [before + 1]))
                before, piece, own = before + 1, "", [0]
                continue
            base = before
            for piece in self.cut(part):
                own = np.array(self.table(piece.encode()))
                ends = np.cumsum([len(x.encode()) for x in piece])
                counts = before + own[ends]
                blank = len(piece) - len(piece.lstrip())
                if blank:
                    # White space at the end of a prefix is one piece, whatever it is cut into when more follows.
                    gap, base = gap + piece[:blank], base if gap else before
                    run = np.array(self.table(gap.encode()))[np.cumsum([len(x.encode()) for x in gap])]
                    counts[:blank] = base + run[-blank:]
                elif piece[0] == "'" and len(piece) == 3 and piece[1].isalpha():
                    counts[1] = before + self.count(piece[0]) + self.count(piece[1])
                if blank < len(piece):
                    gap = ""
                out.append(counts)
                before += int(own[-1])
            gap = ""
        return np.concatenate(out)

    def room(self, found: list[str], counts: np.ndarray, limit: int) -> int:
        """Characters of the first of these pieces, and of as much of the next one as fits, within `limit` tokens."""
        total = np.cumsum(counts)
        whole = int(np.searchsorted(total, limit, side="right"))
        left, piece, characters = limit - (int(total[whole - 1]) if whole else 0), found[whole], 0
        if piece not in self.special:
            own = np.array(self.table(piece.encode()))[np.cumsum([len(x.encode()) for x in piece])]
            characters = int(np.flatnonzero(own <= left)[-1] + 1) if (own <= left).any() else 0
        return characters + sum(map(len, found[:whole]))

    def measured(self, text: str, limit: int) -> tuple[int, int]:
        """The text's tokens, and the characters of its longest prefix within `limit` tokens, from one walk over its pieces."""
        used, before, characters = 0, [], None
        for found, counts in self.steps(text):
            total = int(counts.sum())
            if characters is None and used + total > limit:
                characters = sum(map(len, before)) + self.room(found, counts, limit - used)
            elif characters is None:
                before += found
            used += total
        return used, len(text) if characters is None else characters

    def longest_prefix(self, text: str, limit: int) -> int:
        """Characters of the longest prefix of whole pieces, and as much of the next piece as fits, within `limit` tokens."""
        return self.measured(text, limit)[1]


@functools.lru_cache(maxsize=2)
def _loaded(vocabulary: str) -> PrefixCounts:
    return PrefixCounts(vocabulary)


def token_counts(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit, and the characters within the limit.

    `path` names a byte-level BPE vocabulary file, read on the driver and sent to the tasks; its size is fixed.
    """
    with open(path, encoding="utf-8") as file:
        vocabulary = documents.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _loaded(vocabulary.value)
        for batch in batches:
            counts, room = [], []
            for text in batch.column("text"):
                tokens, characters = counter.measured(text.as_py() or "", limit)
                counts.append(tokens)
                room.append(characters)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64()), pa.array([x > limit for x in counts], pa.bool_()), pa.array(room, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_chars"])

    id_type = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean, limit_chars long")


def prefix_tables(documents: DataFrame, path: str) -> DataFrame:
    """doc_id and prefix_tokens: the token count of every prefix of the text, element i for its first i characters."""
    with open(path, encoding="utf-8") as file:
        vocabulary = documents.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _loaded(vocabulary.value)
        for batch in batches:
            for row in range(batch.num_rows):
                counts = counter.prefixes(batch.column("text")[row].as_py() or "")
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, 1), pa.array([counts], pa.list_(pa.int64()))], ["doc_id", "prefix_tokens"])

    id_type = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, prefix_tokens array<long>")
