"""Token counts by a compiled finite-state transducer.

The tokenizer of a sentencepiece BPE model merges characters by rank. Its result for every prefix of a
text is settled by the last token of that prefix: a token may end here if it is valid alone and the pair of
it and the last token before it is what the merges would give. What later characters can still depend on
is therefore bounded: the longest suffix that begins some piece, and, for each place in it where a piece may
begin, the last token before that place and how many tokens lie between. That is the state of a deterministic
transducer; each transition carries the change in the number of tokens. States and transitions are compiled
when first met and kept in the worker.

Texts are cut into chunks. No piece holds a blank after another character, so a blank after a non-blank returns
to one fixed state, and a chunk that begins there has a constant map. Where no such blank comes, as in Chinese
or base64, chunks are cut at a fixed length, and a chunk's map goes from the states in which it may be entered
to the states and counts that it gives. All chunks run in lockstep over arrays, first from the fixed state and
then from whatever state the chunk before may give, until no map lacks an entry; runs from different states
soon meet, so that is two or three passes. The maps are composed by a parallel prefix scan (pointer doubling).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import pieces

BLANK = "▁"
#: Characters of a chunk, about, and at most where no blank comes.
LANE, LONGEST = 192, 384
#: Above so many states a worker drops the younger half between batches, to bound its memory.
MOST_STATES = 200_000
MOST_PAIRS = 500_000
#: More than any number of states in one batch.
MOST_KEYS = 1 << 32
#: Chunks to which a state found as an entry late is carried at once: texts that repeat themselves go round few states.
AHEAD = 32
#: A rank after all others.
NEVER = 1 << 30


class Transducer:
    """Counts tokens as the sentencepiece library does for the BPE model at ``path``."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.bytes = any(sp.is_byte(i) for i in range(n))
        order = sorted(plain, key=lambda i: -sp.get_score(i))
        self.rank = {sp.id_to_piece(i): r for r, i in enumerate(order)}
        self.prefixes = {p[:k] for p in self.rank for k in range(1, len(p))}
        self.joined = sorted({c for p in self.rank if len(p) > 1 for c in p})
        if any(BLANK in p.lstrip(BLANK) for p in self.rank):
            raise ValueError("pieces hold blanks after other characters; chunks cannot be cut at blanks")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.valid: dict[str, bool] = {}
        self.split: dict[str, tuple[str, str]] = {}
        self.reset()

    def reset(self) -> None:
        # columns 0 to 4: characters of no longer piece, by the tokens they cost; then characters as met
        self.column = np.full(0x110000, -1, np.int32)
        self.chars: list[str] = [""] * 5
        self.wide = 64
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next = np.full((1024, self.wide), -1, np.int32)
        self.emit = np.zeros((1024, self.wide), np.int8)
        self.state(("", ((0, None, 0),)))

    def shrink(self) -> None:
        """Forgets the states met last; those met first are the commonest. What is needed is compiled again."""
        keep = MOST_STATES // 2
        for key in self.states[keep:]:
            del self.ids[key]
        del self.states[keep:]
        self.next[self.next >= keep] = -1
        self.next[keep:] = -1

    def state(self, key: tuple) -> int:
        got = self.ids.get(key)
        if got is None:
            got = self.ids[key] = len(self.states)
            self.states.append(key)
            if got == len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.emit = np.concatenate([self.emit, np.zeros_like(self.emit)])
            for cost in range(5):
                self.next[got, cost], self.emit[got, cost] = 0, cost
        return got

    def cost(self, char: str) -> int:
        return 1 if char in self.rank or not self.bytes else len(char.encode("utf-8", "surrogatepass"))

    def merged(self, text: str, least: int = 1) -> list[str]:
        """The merges, plainly, down to ``least`` parts: for pieces of the vocabulary while compiling."""
        parts = list(text)
        while len(parts) > least:
            best, at = min((self.rank.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def is_token(self, text: str) -> bool:
        got = self.valid.get(text)
        if got is None:
            got = self.valid[text] = len(text) == 1 or text in self.rank and self.merged(text) == [text]
        return got

    def halves(self, token: str) -> tuple[str, str]:
        """The two parts of a token's last merge."""
        got = self.split.get(token)
        if got is None:
            a, b = self.merged(token, 2)
            got = self.split[token] = a, b
        return got

    def follows(self, last: str | None, token: str) -> bool:
        """Whether the merges leave these two tokens side by side.

        Going back in time from both whole, the later of the two merges is undone, so that the parts next to
        the boundary are those that stood there together. They would have merged if their own rank came before
        those of the merges that took them; of equal ranks the left one comes first.
        """
        if last is None:
            return True
        got = self.pairs.get((last, token))
        if got is not None:
            return got
        rank, x, y, x_taken, y_taken = self.rank, last, token, NEVER, NEVER
        while True:
            r = rank.get(x + y, NEVER)
            if r < x_taken and (r <= y_taken if y_taken < NEVER else r < NEVER):
                got = False
                break
            x_made, y_made = (rank[z] if len(z) > 1 else -1 for z in (x, y))
            if x_made < 0 and y_made < 0:
                got = True
                break
            if x_made > y_made:
                x, x_taken = self.halves(x)[1], x_made
            else:
                y, y_taken = self.halves(y)[0], y_made
        self.pairs[last, token] = got
        return got

    def compile(self, at: int, column: int) -> None:
        tail, starts = self.states[at]
        char = self.chars[column]
        if char == BLANK and tail and tail[-1] != BLANK:
            tail, starts = "", ((0, None, 0),)
        for size, last, count in starts:  # longest first
            token = (tail[-size:] if size else "") + char
            if self.is_token(token) and self.follows(last, token):
                delta = count + (self.cost(char) if len(token) == 1 else 1)
                break
        else:
            raise AssertionError("no token fits")
        text = tail + char
        later = tuple((size + 1, last, count - delta) for size, last, count in starts if text[-size - 1 :] in self.prefixes)
        keep = later[0][0] if later else 0
        # a state after a character that continues nothing is kept apart by its last token alone
        to = self.state((text[-keep:] if keep else "", (*later, (0, token, 0))))
        self.next[at, column], self.emit[at, column] = to, delta

    def columns(self, codes: np.ndarray) -> np.ndarray:
        got = self.column[codes]
        if got.size and got.min() < 0:
            joined = set(self.joined)
            for code in np.unique(codes[got < 0]):
                char = chr(code)
                if char in joined:
                    self.column[code] = len(self.chars)
                    self.chars.append(char)
                else:
                    self.column[code] = self.cost(char)
            if len(self.chars) > self.wide:
                more = (-(-len(self.chars) // 64)) * 64 - self.wide
                self.next = np.concatenate([self.next, np.full((len(self.next), more), -1, np.int32)], axis=1)
                self.emit = np.concatenate([self.emit, np.zeros((len(self.emit), more), np.int8)], axis=1)
                self.wide += more
            got = self.column[codes]
        return got

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        if len(self.states) > MOST_STATES:
            self.shrink()
        if len(self.pairs) > MOST_PAIRS:
            self.pairs.clear()
        out = np.zeros(len(texts), np.int64)
        some = [i for i, t in enumerate(texts) if t]
        if not some:
            return out
        stream = "".join([" " + texts[i] for i in some])
        codes = np.frombuffer(stream.encode("utf-32-le", "surrogatepass"), np.uint32)
        blank = (codes == 0x20) | (codes == ord(BLANK))
        codes = np.where(blank, ord(BLANK), codes)
        first = np.cumsum([0, *(len(texts[i]) + 1 for i in some[:-1])])
        sync = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
        sync = sync[np.diff(sync // LANE, prepend=-1) > 0]
        fixed = np.union1d(first, sync)
        # chunks of at most LONGEST characters: the fixed starts and further ones at equal steps after each
        parts = -(-np.diff(fixed, append=len(codes)) // LONGEST)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(fixed, parts) + step * LONGEST
        size = np.diff(start, append=len(codes))
        cols = self.columns(codes)
        chunk = np.arange(len(start))
        loose = step > 0
        # the maps so far: of each known (chunk, entry), its exit and count
        exits, tokens = self.passed(cols, start, size, np.zeros(len(start), np.int64))
        known = [(chunk, np.zeros(len(start), np.int64), exits, tokens)]
        after = chunk[loose]
        at, entry = after, exits[after - 1]
        last = np.append(np.flatnonzero(~loose)[1:], len(start))[np.cumsum(~loose) - 1] - 1  # of the chunks that hang together
        seen = after * MOST_KEYS  # the fixed state is known as an entry of all
        while len(at):
            key = at * MOST_KEYS + entry
            if len(known) > 2:
                n = np.minimum(last[at] - at + 1, AHEAD)
                key = np.repeat(key, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * MOST_KEYS
            fresh = np.unique(key[~np.isin(key, seen)])
            if not len(fresh):
                break
            seen = np.concatenate([seen, fresh])
            at, entry = np.divmod(fresh, MOST_KEYS)
            exits, tokens = self.passed(cols, start[at], size[at], entry)
            known.append((at, entry, exits, tokens))
            more = (at + 1 < len(start)) & loose[np.minimum(at + 1, len(start) - 1)]
            at, entry = at[more] + 1, exits[more]
        return self.composed(out, some, first, start, loose, *map(np.concatenate, zip(*known)))

    def passed(self, cols: np.ndarray, start: np.ndarray, size: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exit state, count) of each chunk from its entry state; all run in lockstep."""
        order = np.argsort(-size, kind="stable")
        begin, size = start[order], size[order]
        state = entry[order].astype(np.int64)
        count = np.zeros(len(begin), np.int64)
        active = len(begin) - np.searchsorted(size[::-1], np.arange(1, size[0] + 1), side="left")
        for i, n in enumerate(active):
            cell = state[:n] * self.wide + cols[begin[:n] + i]
            to = self.next.ravel().take(cell)
            if to.min() < 0:
                for x in np.unique(cell[to < 0]):
                    self.compile(*divmod(int(x), self.wide))
                to = self.next.ravel().take(cell)
            count[:n] += self.emit.ravel().take(cell)
            state[:n] = to
        exits, tokens = np.empty_like(state), np.empty_like(count)
        exits[order], tokens[order] = state, count
        return exits, tokens

    def composed(self, out: np.ndarray, some: list[int], first: np.ndarray, start: np.ndarray, loose: np.ndarray, chunk: np.ndarray, entry: np.ndarray, exits: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Counts of the texts ``some`` in ``out``: the chunks' maps, one row an entry, composed by pointer doubling."""
        key = chunk * MOST_KEYS + entry
        order = np.argsort(key, kind="stable")
        key, chunk, exits, tokens = key[order], chunk[order], exits[order], tokens[order]
        follows = np.append(loose, False)[chunk + 1]
        end = len(key)
        to = np.where(follows, np.searchsorted(key, (chunk + 1) * MOST_KEYS + exits), end)
        to, total = np.append(to, end), np.append(tokens, 0)
        while (to < end).any():
            total, to = total + total[to], to[to]
        # of each run of chunks that hang together, the first row is that of the fixed state
        head = np.flatnonzero(~loose)
        runs = total[np.searchsorted(key, head * MOST_KEYS)]
        out[some] = np.add.reduceat(runs, np.searchsorted(start[head], first))
        return out


@cache
def transducer(path: str) -> Transducer:
    return Transducer(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    ``path`` of a sentencepiece BPE model, on every executor. Counts are those of the library without begin,
    end or added special tokens; special strings in a text are ordinary text. Null and empty texts have none.
    Whole texts count, however long; their working set is bounded by the longest of them. Rows keep their
    number, repeats included; columns other than doc_id and text are ignored. An empty table stays empty.
    """

    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = d.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    kind = out.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            for rows, texts in pieces(batch, "text"):
                n = t.counts(texts)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return out.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
