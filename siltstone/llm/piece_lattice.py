"""SentencePiece encoding and decoding with exact N-best segmentations.

A text is a lattice: nodes are the places between characters, edges the vocabulary's pieces, and
one edge of a character's UTF-8 bytes where no piece has that character alone. Forward Viterbi
gives the best score from the start to every node. Those scores are exact heuristics for an A*
search backwards from the end, which therefore pops complete segmentations best first and
expands nothing that a better one doesn't need.

No piece of the vocabulary runs across the beginning of a word (spaces lead words) or a line
feed, which is checked when it is loaded. So the lattice falls into chunks there. A chunk keeps
its best path and the gap to its second best; the N best of a whole text can differ from its best
in the N-1 chunks of least gap alone, so only those are searched, and the same order merges
their lists. Whole texts are encoded, whatever their length.

Scores are integers (millionths), so sums are exact and ties are real. Among equals the best is
the one of smaller piece ids, read from the end; further ones come in the search's own fixed
order within a chunk, and over the text those that depart from the best at an earlier chunk. The vocabulary file stores merge ranks instead of
probabilities; "zipf" takes the probability of rank r to be 1 / ((r + 1) H), "stored" its own
scores. Decoding joins the pieces' bytes and drops the leading space: encoding is lossless for
every text, a literal U+2581 included, which goes by its bytes.

Defined results: null and empty texts have no pieces, score 0 and no alternatives (decoded: the
empty text); repeated rows are encoded each; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.common import map_rows, table

SCALE = 1_000_000
NO_SECOND = 1 << 60
CACHED = 250_000
TOGETHER = 48
NO_PIECE = 1 << 40
SPACE = "▁"


@dataclass(frozen=True)
class Params:
    """``best`` segmentations per text, of the vocabulary ``model`` in the folder ``tokenizers``."""

    tokenizers: str = "/opt/tokenizers"
    model: str = "piece_bpe_32k.model"
    best: int = 4
    scores: str = "zipf"


class Lattice:
    def __init__(self, p: Params) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=f"{p.tokenizers}/{p.model}")
        self.best = p.best
        ids = range(sp.vocab_size())
        plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        text = {i: sp.id_to_piece(i).replace(SPACE, " ") for i in plain}
        if p.scores == "zipf":
            ranked = sorted(plain, key=lambda i: (-sp.get_score(i), i))
            harmonic = math.log(sum(1 / (r + 1) for r in range(len(ranked))))
            score = {i: -round(SCALE * (math.log(r + 1) + harmonic)) for r, i in enumerate(ranked)}
        else:
            score = {i: round(SCALE * sp.get_score(i)) for i in plain}
        self.unknown = min(score.values()) - 10 * SCALE
        self.byte_ids = [0] * 256
        self.bytes = [b""] * len(ids)
        for i in ids:
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_ids[value], self.bytes[i] = i, bytes([value])
        # pieces and, with id -1, their beginnings: a missing entry ends the walk
        self.entries: dict[str, tuple[int, int]] = {}
        for i, t in text.items():
            self.bytes[i] = t.encode("utf-8")
            for k in range(1, len(t)):
                self.entries.setdefault(t[:k], (-1, 0))
        for i, t in text.items():
            self.entries[t] = (i, score[i])
        apart = not any(re.search("[^ ] |\n", t) for t in text.values())
        self.chunks = re.compile(" +[^ \n]*|\n|[^ \n]+" if apart else r"(?s).+").findall
        self.cache: dict[str, tuple[bytes, int, int]] = {}
        node = {"": 0} | {t: k for k, t in enumerate(self.entries, 1)}
        steps = sorted(((node[t[:-1]] << 21) | ord(t[-1]), node[t]) for t in self.entries)
        self.trie_keys = np.array([k for k, _ in steps], dtype=np.int64)
        self.trie_next = np.array([k for _, k in steps], dtype=np.int64)
        self.trie_piece = np.array([-1, *(e[0] for e in self.entries.values())], dtype=np.int64)
        self.trie_score = np.array([0, *(e[1] for e in self.entries.values())], dtype=np.int64)

    def edges(self, chunk: str) -> list[list[tuple[int, int, int]]]:
        """For every node the edges into it: (from, piece id or -1 - byte, score)."""
        n, get = len(chunk), self.entries.get
        into: list[list[tuple[int, int, int]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            alone = False
            for j in range(i + 1, n + 1):
                e = get(chunk[i:j])
                if e is None:
                    break
                if e[0] >= 0:
                    into[j].append((i, e[0], e[1]))
                    alone = alone or j == i + 1
            if not alone:
                into[i + 1].append((i, -1, self.unknown))
        return into

    @staticmethod
    def forward(into: list[list[tuple[int, int, int]]]) -> tuple[list[int], list[int], list[tuple[int, int]]]:
        """Best and second-best score to every node, and the best edge into it."""
        best, second, back = [0], [-NO_SECOND], [(0, NO_PIECE)]
        for edges in into[1:]:
            top, below, edge = -NO_SECOND, -NO_SECOND, (0, NO_PIECE)
            for i, piece, s in edges:
                c, c2 = best[i] + s, second[i] + s
                if c > top or (c == top and piece < edge[1]):
                    top, c, edge = c, top, (i, piece)
                below = max(below, c, c2)
            best.append(top)
            second.append(max(below, -NO_SECOND))
            back.append(edge)
        return best, second, back

    def spelled(self, chunk: str, steps: list[tuple[int, int]]) -> list[int]:
        """Piece ids of (node, piece) steps in reading order, bytes spelled out."""
        out = []
        for i, piece in steps:
            if piece >= 0:
                out.append(piece)
            else:
                out.extend(self.byte_ids[b] for b in chunk[i].encode("utf-8", "surrogatepass"))
        return out

    def solve(self, chunks: set[str]) -> None:
        """Puts (ids of the best path as int32 bytes, its score, gap to the second best) of every
        chunk into the cache; short chunks of one length go through the forward pass together."""
        if len(self.cache) > CACHED:
            self.cache.clear()
        by_length: dict[int, list[str]] = {}
        for c in chunks:
            if c not in self.cache:
                by_length.setdefault(len(c), []).append(c)
        for n, group in by_length.items():
            if n <= TOGETHER and len(group) > 8:
                for k in range(0, len(group), 8192):
                    self._solve_together(group[k : k + 8192], n)
            else:
                for c in group:
                    best, second, back = self.forward(self.edges(c))
                    self._keep(c, best[-1], second[-1], back)

    def _keep(self, chunk: str, best: int, second: int, back: list[tuple[int, int]]) -> None:
        steps, j = [], len(chunk)
        while j:
            steps.append(back[j])
            j = back[j][0]
        ids = np.array(self.spelled(chunk, steps[::-1]), dtype=np.int32).tobytes()
        self.cache[chunk] = ids, best, best - second if best - second < NO_SECOND >> 1 else NO_SECOND

    def _solve_together(self, group: list[str], n: int) -> None:
        """forward() over chunks of n characters in lockstep: the trie is walked from every node
        by all chunks whose characters still follow it."""
        codes = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, n).astype(np.int64)
        rows = len(group)
        best = np.full((n + 1, rows), -NO_SECOND, dtype=np.int64)
        second = np.full((n + 1, rows), -NO_SECOND, dtype=np.int64)
        piece = np.full((n + 1, rows), NO_PIECE, dtype=np.int64)
        origin = np.zeros((n + 1, rows), dtype=np.int64)
        best[0] = 0

        def relax(j: int, at: np.ndarray, i: int, ids: np.ndarray, s: np.ndarray) -> None:
            c, top = best[i, at] + s, best[j, at]
            wins = (c > top) | ((c == top) & (ids < piece[j, at]))
            second[j, at] = np.maximum(np.maximum(second[j, at], np.where(wins, top, c)), second[i, at] + s)
            won = at[wins]
            best[j, won], piece[j, won], origin[j, won] = c[wins], ids[wins], i

        for i in range(n):
            at, node = np.arange(rows), np.zeros(rows, dtype=np.int64)
            alone = np.zeros(rows, dtype=bool)
            for j in range(i + 1, n + 1):
                keys = (node << 21) | codes[at, j - 1]
                place = np.minimum(np.searchsorted(self.trie_keys, keys), len(self.trie_keys) - 1)
                on = self.trie_keys[place] == keys
                at, node = at[on], self.trie_next[place[on]]
                if not len(at):
                    break
                ids = self.trie_piece[node]
                ends = ids >= 0
                if ends.any():
                    relax(j, at[ends], i, ids[ends], self.trie_score[node[ends]])
                    if j == i + 1:
                        alone[at[ends]] = True
            lone = np.flatnonzero(~alone)
            if len(lone):
                relax(i + 1, lone, i, np.full(len(lone), -1), np.full(len(lone), self.unknown))
        # back from the end, all chunks together; rows with bytes are spelled one by one
        j, path = np.full(rows, n), np.full((n, rows), -2, dtype=np.int32)
        count, whole, every = np.zeros(rows, dtype=np.int64), np.ones(rows, dtype=bool), np.arange(rows)
        for step in range(n):
            live = j > 0
            if not live.any():
                break
            ids = piece[j, every]
            path[n - 1 - step, live] = ids[live]
            whole &= ~live | (ids >= 0)
            count += live
            j = np.where(live, origin[j, every], 0)
        path = np.ascontiguousarray(path.T)
        gaps = best[n] - second[n]
        gaps = np.where(gaps < NO_SECOND >> 1, gaps, NO_SECOND).tolist()
        score, count = best[n].tolist(), count.tolist()
        for r, chunk in enumerate(group):
            if whole[r]:
                self.cache[chunk] = path[r, n - count[r] :].tobytes(), score[r], gaps[r]
            else:
                self._keep(chunk, score[r], int(second[n, r]), list(zip(origin[:, r].tolist(), piece[:, r].tolist(), strict=True)))

    def nbest(self, chunk: str, n: int) -> list[tuple[int, list[int]]]:
        """The n best segmentations of a chunk as (score, ids), by backward A*. The newest of equal
        hypotheses goes first, and smaller piece ids are pushed last: the first result is the path
        of forward()'s back pointers."""
        into = self.edges(chunk)
        ahead = self.forward(into)[0]
        # (cost of the best completion, order, node, score of the suffix, linked steps)
        heap: list[tuple] = [(-ahead[-1], 0, len(chunk), 0, None)]
        out, order = [], 0
        while heap and len(out) < n:
            _, _, j, suffix, steps = heapq.heappop(heap)
            if j == 0:
                path = []
                while steps:
                    path.append(steps[0])
                    steps = steps[1]
                out.append((suffix, self.spelled(chunk, path)))
                continue
            for i, piece, s in sorted(into[j], key=lambda e: -e[1]):
                order -= 1
                heapq.heappush(heap, (-(suffix + s + ahead[i]), order, i, suffix + s, ((i, piece), steps)))
        return out

    def encode_all(self, texts: list[str | None]) -> list[dict]:
        chunked = [self.chunks(" " + t) if t else [] for t in texts]
        self.solve({c for cs in chunked for c in cs})
        return [self._join(cs) for cs in chunked]

    def encode(self, text: str | None) -> dict:
        return self.encode_all([text])[0]

    def _join(self, chunks: list[str]) -> dict:
        """Best ids and score of a text; every further segmentation as score and edits of the best
        ids. The chunks are in the cache."""
        found = [self.cache[c] for c in chunks]
        ids = np.frombuffer(b"".join([f[0] for f in found]), dtype=np.int32)
        score = sum([f[1] for f in found])
        near = heapq.nsmallest(self.best - 1, ((f[2], k) for k, f in enumerate(found) if f[2] < NO_SECOND))
        # merged lists: (loss, ranks from the last chunk to the first, edits)
        merged: list[tuple[int, tuple[int, ...], list]] = [(0, (), [])]
        starts = list(accumulate((len(f[0]) // 4 for f in found), initial=0)) if near else []
        for k in sorted(k for _, k in near):
            ways = self.nbest(chunks[k], self.best)
            edit = lambda r, k=k, ways=ways: [] if r == 0 else [{"at": starts[k], "dropped": starts[k + 1] - starts[k], "ids": ways[r][1]}]
            grown = [(loss + ways[0][0] - ways[r][0], (r, *ranks), r, edits) for loss, ranks, edits in merged for r in range(len(ways))]
            merged = [(loss, ranks, edits + edit(r)) for loss, ranks, r, edits in heapq.nsmallest(self.best, grown, key=lambda x: x[:2])]
        return {"ids": ids, "score": score, "alternatives": [{"score": score - loss, "edits": edits} for loss, _, edits in merged[1:]]}

    def decode(self, ids) -> str:
        """The text of piece ids; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join([self.bytes[i] for i in ids])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def apply_edits(ids: list[int], edits: list[dict]) -> list[int]:
    """Piece ids of an alternative from the best ones and its edits."""
    out, done = [], 0
    for e in edits:
        out += [*ids[done : e["at"]], *e["ids"]]
        done = e["at"] + e["dropped"]
    return [*out, *ids[done:]]


SCHEMA = (
    "doc_id bigint, n_pieces bigint, score bigint, ids array<int>, "
    "alternatives array<struct<score:bigint,edits:array<struct<at:int,dropped:int,ids:array<int>>>>>, lossless boolean, text_sha256 string"
)


def encode(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Every row's segmentations, and what decoding the best one gives: whether it is the text
    again (null as the empty one), and its digest."""
    state: list[Lattice] = []

    def rows(got: dict[str, list]) -> dict[str, list]:
        if not state:
            state.append(Lattice(p))
        made = state[0].encode_all(got["text"])
        back = [state[0].decode(m["ids"].tolist()) for m in made]
        return {
            "doc_id": got["doc_id"],
            "n_pieces": [len(m["ids"]) for m in made],
            "score": [m["score"] for m in made],
            "ids": [m["ids"] for m in made],
            "alternatives": [m["alternatives"] for m in made],
            "lossless": [b == (t or "") for b, t in zip(back, got["text"], strict=True)],
            "text_sha256": [hashlib.sha256(b.encode("utf-8", "replace")).hexdigest() for b in back],
        }

    return map_rows(docs, ["doc_id", "text"], SCHEMA, rows)


def op1_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, p: Params = Params()) -> DataFrame:
    """Pipeline stage, the last one: the encoded corpus."""
    return encode(docs, p)
