"""Operator 6: scoring by a log-bilinear neural model.

Words are coded by a 64-bit hash whose low bits name their ending; a slice of
texts is split, lower-cased and coded by Arrow and numpy as a whole. The model's
types are the training words, most frequent first and as many as the parameter
`types` lets in, one class per ending for words beyond them, and the end of a
text. The two words before a token predict it: with a vector r of each type,
h = c1 * r[previous] + c2 * r[the one before] and the score of a type is
h . q[type] + b[type]. Types are dealt by frequency over about sqrt(types)
groups, and a token's probability is that of its group times that within the
group, each a softmax over some hundred scores. So it is normalised exactly,
by batched matrix products, at a cost that grows with the root of the types.

Training is noise-contrastive estimation in numpy: groups and words are told
from sampled noise. Every task trains on all texts of its partition, from the
same start (the unigram model); what it changed is averaged row by row, weighted
by how often the task met the row, in a shuffled aggregation. So all training
texts are learnt from, and what is gathered grows with them: counts of all
words, and each task's changes.

What is broadcast is bounded by two parameters: the model by its types, the
table of frequent words by HEAD entries. Rarer words are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix, require, slices

ENDINGS = 64
#: Frequent words whose counts are broadcast, at most (16 bytes each).
HEAD = 500_000
_POINT = 0xC2B2AE3D27D4EB4F
#: Word types of the model, at most (140 bytes each): a bound of memory. With the
#: endings and the end they are 128 groups of 128.
WORDS = 16_319
SIZE, BATCH, GROUP_NOISE, WORD_NOISE, RATE = 16, 4096, 32, 2, 0.1


def word_codes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's bytes, with the ending's class (of its last two bytes) in the low bits."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = words.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    start, end = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    power, inverse = _powers(1 << int(len(data)).bit_length())
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * power[: len(data)])])
    hashed = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    padded = np.concatenate([np.zeros(2, np.uint64), data])
    # Where a word is shorter than two bytes, its length stands in for the missing one.
    last, other = padded[end + 1], np.where(end - start > 1, padded[end], (end - start).astype(np.uint64))
    ending = mix(last * np.uint64(257) + other) % np.uint64(ENDINGS)
    return (hashed & ~np.uint64(ENDINGS - 1) | ending).view(np.int64)


@lru_cache(maxsize=8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a number modulo 2^64, and of its inverse."""
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (_POINT, pow(_POINT, -1, 2**64)))


def word_code(word: bytes) -> int:
    return int(word_codes(pa.array([word], pa.binary()))[0])


@dataclass
class Types:
    """Types by falling frequency; type t is member t // groups of group t % groups."""

    codes: np.ndarray  # of the type words, sorted (int64)
    of_code: np.ndarray  # their types
    of_ending: np.ndarray  # type of each class of endings
    counts: np.ndarray  # training tokens of each type

    def __post_init__(self):
        self.groups = int(np.ceil(np.sqrt(len(self.counts))))
        self.members = -(-len(self.counts) // self.groups)
        share = np.zeros(self.groups * self.members)
        share[: len(self.counts)] = self.counts + 0.5
        share = share.reshape(self.members, self.groups).T / share.sum()
        self.group_share, self.share = share.sum(axis=1), share / share.sum(axis=1, keepdims=True)

    @property
    def start(self) -> int:
        """What stands before a text, as a type."""
        return len(self.counts)

    def of(self, codes: np.ndarray) -> np.ndarray:
        out = self.of_ending[codes & (ENDINGS - 1)]
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        found = self.codes[at] == codes
        out[found] = self.of_code[at[found]]
        return out

    def before(self, types: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The types one and two before each token; starts: first token of each text."""
        one = np.concatenate([[self.start], types[:-1]])
        one[starts] = self.start
        two = np.concatenate([[self.start], one[:-1]])
        two[starts] = self.start
        return one, two


#: Parameters: vectors of types in a context, their weights by place, groups, words within groups.
#: A row of the last two ends with its bias.
def unlearnt(types: Types, seed: int = 1) -> dict[str, np.ndarray]:
    random = np.random.default_rng(seed)
    some = lambda n: random.normal(0, 0.1, (n, SIZE)).astype(np.float32)
    log = lambda p: np.log(np.maximum(p, 1e-30)).astype(np.float32).reshape(-1, 1)
    return {
        "r": some(types.start + 1),
        "c": np.ones((2, SIZE), np.float32),
        "g": np.hstack([some(types.groups), log(types.group_share)]),
        "w": np.hstack([some(types.groups * types.members), log(types.share)]),
    }


class Trainer:
    """Noise-contrastive estimation over batches of (two before, one before, token)."""

    def __init__(self, types: Types, seed: int):
        self.types, self.random = types, np.random.default_rng(seed)
        self.now = {k: v.copy() for k, v in unlearnt(types).items()}
        self.squares = {k: np.full(len(v), 1e-3, np.float32) for k, v in self.now.items()}
        self.met = {k: np.zeros(len(v), np.int64) for k, v in self.now.items()}
        self.edges = np.cumsum(types.group_share)[:-1]
        # Members drawn by frequency, a thousand for each group; those that this leaves out are no noise.
        points = (np.arange(1024) + 0.5) / 1024
        self.drawn = np.array([np.searchsorted(b, points) for b in np.cumsum(types.share, axis=1)[:, :-1]])
        log = lambda share, k: np.log(np.maximum(k * share, 1e-30)).astype(np.float32)
        self.log_group, self.log_word = log(types.group_share, GROUP_NOISE), log(types.share.ravel(), WORD_NOISE)

    def change(self, name: str, rows: np.ndarray, slope: np.ndarray) -> None:
        """One adaptive step for each row; rows may repeat."""
        if len(self.now[name]) <= 1 << 16:
            rows = rows.astype(np.uint16)  # sorted by digits
        order = np.argsort(rows, kind="stable")
        rows = rows[order].astype(np.int64)
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        total, at = np.add.reduceat(slope[order], first, axis=0), rows[first]
        square = self.squares[name][at] + np.einsum("ij,ij->i", total, total) / total.shape[1]
        self.squares[name][at] = square
        self.now[name][at] -= total * (RATE / np.sqrt(square))[:, None]
        self.met[name][at] += np.diff(first, append=len(rows))

    def step(self, two: np.ndarray, one: np.ndarray, token: np.ndarray) -> None:
        t, r, c, g, w = self.types, *(self.now[k] for k in "rcgw")
        v1, v2 = r[one], r[two]
        h = np.empty((len(token), SIZE + 1), np.float32)
        h[:, :SIZE] = v1 * c[0] + v2 * c[1]
        h[:, SIZE] = 1
        group, member = token % t.groups, token // t.groups
        noise = np.searchsorted(self.edges, self.random.random(GROUP_NOISE))
        rows = g[group]
        data = told(np.einsum("ij,ij->i", h, rows), self.log_group[group])[:, None] - 1
        other = told(h @ g[noise].T, self.log_group[noise])
        back = data * rows + other @ g[noise]
        self.change("g", np.concatenate([group, noise]), np.concatenate([data * h, other.T @ h]))
        place = np.empty((len(token), WORD_NOISE + 1), np.int64)
        place[:, 0] = member
        place[:, 1:] = self.drawn[group[:, None], self.random.integers(0, 1024, (len(token), WORD_NOISE))]
        place += group[:, None] * t.members
        rows = w[place]
        hint = told(np.einsum("ij,ikj->ik", h, rows), self.log_word[place])
        hint[:, 0] -= 1
        back += np.einsum("ik,ikj->ij", hint, rows)
        self.change("w", place.ravel(), (hint[:, :, None] * h[:, None, :]).reshape(-1, SIZE + 1))
        back = back[:, :SIZE]
        self.change("r", np.concatenate([one, two]), np.concatenate([back * c[0], back * c[1]]))
        self.change("c", np.arange(2), np.stack([np.einsum("ij,ij->j", back, v1), np.einsum("ij,ij->j", back, v2)]))
        self.met["c"] += len(token) - 1

    def learn(self, tokens: np.ndarray, starts: np.ndarray) -> None:
        one, two = self.types.before(tokens, starts)
        order = self.random.permutation(len(tokens))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            self.step(two[some], one[some], tokens[some])


def told(score: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Probability that a sample with this score is none of the noise, whose expected number's logarithm is given."""
    return 1 / (1 + np.exp(noise - score))


#: Places of the parameters in one numbering of rows.
def _offsets(types: Types) -> dict[str, int]:
    sizes = {"r": types.start + 1, "c": 2, "g": types.groups, "w": types.groups * types.members}
    return dict(zip(sizes, np.cumsum([0, *sizes.values()])[:-1].tolist()))


class Model:
    """Normalised log-probabilities of tokens."""

    def __init__(self, types: Types, params: dict[str, np.ndarray]):
        self.types, self.params = types, params

    def log10p(self, two: np.ndarray, one: np.ndarray, token: np.ndarray) -> np.ndarray:
        t, (r, c, g, w) = self.types, (self.params[k] for k in "rcgw")
        w = w.reshape(t.groups, t.members, SIZE + 1)
        out = np.empty(len(token), np.float32)
        group, member = token % t.groups, token // t.groups
        order = np.argsort(group, kind="stable")
        for at in range(0, len(order), 8192):
            some = order[at : at + 8192]
            h = np.hstack([r[one[some]] * c[0] + r[two[some]] * c[1], np.ones((len(some), 1), np.float32)])
            mine = group[some]
            out[some] = self._of(h, g, mine)
            cuts = np.flatnonzero(np.diff(mine, prepend=-1))
            for low, high in zip(cuts, [*cuts[1:], len(some)]):
                out[some[low:high]] += self._of(h[low:high], w[mine[low]], member[some[low:high]])
        return out / np.float32(np.log(10))

    @staticmethod
    def _of(h: np.ndarray, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of the softmax over rows at each target."""
        score = h @ rows.T
        own = score[np.arange(len(target)), target]
        with np.errstate(over="ignore", divide="ignore"):
            out = own - np.log(np.exp(score, out=score) @ np.ones(len(rows), np.float32))
        if not np.isfinite(out).all():  # scores beyond the range of exp
            score = h @ rows.T
            top = score.max(axis=1)
            out = own - top - np.log(np.exp(score - top[:, None]).sum(axis=1))
        return out


#: No word has white space, so this can't be one.
END_CODE = word_code(b"\n")


def _words(part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the distinct words of a slice's texts, the place among them of each token, and of each text's first token.

    The last code is the end's, which closes every text.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(part, "")))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    full = pc.binary_length(flat).to_numpy() > 0  # text that begins or ends with a space
    before = np.concatenate([[0], np.cumsum(full)])
    ends = before[offsets - offsets[0]]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    # The end after each text.
    tokens = np.full(len(coded) + len(part), len(coded.dictionary), np.int32)
    own = np.ones(len(tokens), bool)
    own[ends[1:] + np.arange(len(part))] = False
    tokens[own] = coded.indices.to_numpy()
    return np.append(word_codes(coded.dictionary), END_CODE), tokens, ends[:-1] + np.arange(len(part))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        codes, back = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
        n = np.bincount(back, np.concatenate([n for _, n in held]))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], names=["code", "n"])

    for batch in batches:
        for part in slices(batch, 1024):
            if part.num_rows:
                codes, tokens, _ = _words(part.column(0))
                held.append((codes, np.bincount(tokens, minlength=len(codes))))
            if sum(len(c) for c, _ in held) > 1_500_000:
                yield out()
    if held:
        yield out()


def held_out(doc_id: Column, of: int = 7, one: int = 2) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is for training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == one, F.lit(False))


@dataclass
class Learnt:
    """What the training texts give: the model, the frequent words, and all counts."""

    model: Model
    codes: np.ndarray  # of the frequent words, sorted
    counts: np.ndarray
    of_class: np.ndarray  # log10 of what shares of words beyond the types are divided by, by ending
    tokens: int
    distinct: int
    rest: DataFrame  # (code, n) of all other words


def learn(texts: DataFrame, *, words: int = WORDS, head: int = HEAD) -> Learnt:
    """Count the words of texts (one column) and train the model on them.

    All texts are learnt from; each partition from the same start, so the
    result depends a little on the partitions. words and head bound the memory
    of a worker, not what is read.
    """
    spark = texts.sparkSession
    counts = materialise(texts.mapInArrow(_count_words, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "words")
    level = F.floor(F.log2("n") * 16)
    levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n"), F.min("n").alias("least")).orderBy(F.desc("level")).collect()
    # Whole levels of frequency, and of the first one that doesn't fit a share by hash.
    least, share, held = 1 << 62, 0, 0
    for r in levels:
        if held + r.words > head:
            share = int(65536 * 0.98 * max(0, head - held - 1000) / r.words)
            break
        held, least = held + r.words, r.least
    cut = r.least if share else least
    frequent = (F.col("n") >= least) | ((F.col("n") >= cut) & (F.shiftrightunsigned("code", 48) < share)) | (F.col("code") == END_CODE)
    table = counts.filter(frequent).toArrow().sort_by("code")
    codes, n = table.column("code").to_numpy(), table.column("n").to_numpy().astype(np.int64)
    end = np.int64(END_CODE)
    order = np.lexsort((codes, -n))
    order = order[codes[order] != end][:words]

    # Words of each ending that are no types, and their tokens.
    rare = np.zeros((ENDINGS, 2), np.int64)
    for r in counts.groupBy(F.col("code").bitwiseAND(ENDINGS - 1).alias("e")).agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).collect():
        rare[r.e] = r.v, r.n
    ends = n[codes == end].sum()
    gone = np.append(codes[order], end if ends else np.empty(0, np.int64))
    np.subtract.at(rare, gone & (ENDINGS - 1), np.column_stack([np.ones(len(gone), np.int64), np.append(n[order], ends if ends else np.empty(0, np.int64))]))

    # Types in the order of words, endings, the end; then renumbered by frequency.
    of_type = np.concatenate([n[order], rare[:, 1], [ends]])
    place = np.empty(len(of_type), np.int64)
    place[np.argsort(-of_type, kind="stable")] = np.arange(len(of_type))
    known = np.append(codes[order], end)
    by_code = np.argsort(known)
    types = Types(known[by_code], np.append(place[: len(order)], place[-1])[by_code], place[len(order) : -1], np.sort(of_type)[::-1].copy())

    shared = spark.sparkContext.broadcast(types)
    names = [f"x{i}" for i in range(SIZE + 1)]

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, trainer = shared.value, None
        for batch in batches:
            for part in slices(batch):
                if part.num_rows:
                    trainer = trainer or Trainer(types, TaskContext.get().partitionId())
                    some, tokens, starts = _words(part.column(0))
                    trainer.learn(types.of(some)[tokens], starts)
        if trainer is None:
            return
        before, offsets = unlearnt(types), _offsets(types)
        for k, v in trainer.now.items():
            met = trainer.met[k]
            rows = np.flatnonzero(met)
            for at in range(0, len(rows), 8192):
                some = rows[at : at + 8192]
                moved = np.zeros((len(some), SIZE + 1))
                moved[:, : v.shape[1]] = (v[some] - before[k][some]) * met[some, None]
                yield pa.RecordBatch.from_arrays([pa.array(some + offsets[k]), pa.array(met[some]), *(pa.array(moved[:, i]) for i in range(SIZE + 1))], names=["row", "met", *names])

    moved = texts.mapInArrow(train, "row long, met long, " + ", ".join(f"{x} double" for x in names)).groupBy("row").agg(F.sum("met").alias("met"), *(F.sum(x).alias(x) for x in names))
    found = moved.select("row", *((F.col(x) / F.col("met")).cast("float").alias(x) for x in names)).toArrow()
    params, rows = unlearnt(types), found.column("row").to_numpy()
    mean = np.column_stack([found.column(x).to_numpy() for x in names]).astype(np.float32) if len(rows) else np.empty((0, SIZE + 1), np.float32)
    for k, low in _offsets(types).items():
        mine = (rows >= low) & (rows < low + len(params[k]))
        params[k][rows[mine] - low] += mean[mine, : params[k].shape[1]]
    return Learnt(Model(types, params), codes, n, np.log10(rare.sum(axis=1) + 1.0), sum(r.n for r in levels), sum(r.words for r in levels), counts.filter(~frequent))


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, head: int = HEAD, learnt: Learnt | None = None) -> DataFrame:
    """Score all texts by a model learnt from those that held_out leaves, or by a given one.

    Returns (id_col, held_out, n_tokens, n_known, train_tokens, base_score,
    score), a row per input row. Tokens are a text's words, A-Z lower-cased,
    and one end. base_score is the add-one unigram log10 probability, score
    the model's; a word beyond the types has its class's probability times its
    add-one share of the class, in which unknown words together count once.
    Null and empty texts are an end alone; very long texts are read whole.
    Repeated rows are all learnt from and scored; null ids are for training;
    without training texts counts are zero and the model is uniform over
    groups and their members; an empty table gives no rows; other columns are
    not read. words and head bound the memory of a worker.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    key = docs.select(id_col).dtypes[0][1]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), held_out(F.col(id_col)).alias("out"))
    learnt = learnt or learn(rows.filter("not out").select("text"), words=words, head=head)
    log_all = np.log10(learnt.tokens + learnt.distinct + 1)
    table = spark.sparkContext.broadcast((learnt.model, learnt.codes, np.log10(learnt.counts + 1.0), learnt.of_class))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, head_codes, head_log, of_class = table.value
        types = model.types
        classes = np.zeros(types.start, bool)
        classes[types.of_ending] = True
        for batch in batches:
            for part in slices(batch):
                if not part.num_rows:
                    continue
                some, back, starts = _words(part.column(1))
                at = np.minimum(np.searchsorted(head_codes, some), max(len(head_codes) - 1, 0))
                known = head_codes[at] == some if len(head_codes) else np.zeros(len(some), bool)
                logs = np.where(known, head_log[at], 0.0) if len(head_codes) else np.zeros(len(some))
                kinds = types.of(some)
                share = np.where(classes[kinds], logs - of_class[some & (ENDINGS - 1)], 0.0)
                kinds = kinds[back]
                one, two = types.before(kinds, starts)
                each = model.log10p(two, one, kinds).astype(np.float64) + share[back]
                add = lambda x: np.add.reduceat(x, starts)
                lengths = np.diff(starts, append=len(back))
                missing = ~known[back]
                lost = add(missing.astype(np.int64))
                tail = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lost)]), pa.int32()), pa.array(some[back[missing]]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(lengths), pa.array(lengths - lost), pa.array(add(logs[back]) - lengths * log_all), pa.array(add(each)), tail],
                    names=["id", "out", "n_tokens", "known", "base", "score", "tail"],
                )

    scored = rows.select("id", "text", "out").mapInArrow(score, f"id {key}, out boolean, n_tokens long, known long, base double, score double, tail array<long>")
    scored = materialise(scored.select(F.monotonically_increasing_id().alias("row"), "*"), "scored")
    rest = scored.select("row", F.explode("tail").alias("code")).join(learnt.rest, "code")
    rest = rest.groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("log"))
    both = scored.join(rest, "row", "left")
    log, more = F.coalesce("log", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return both.select(
        F.col("id").alias(id_col), F.col("out").alias("held_out"), "n_tokens", (F.col("known") + more).alias("n_known"), F.lit(learnt.tokens).cast("long").alias("train_tokens"), (F.col("base") + log).alias("base_score"), (F.col("score") + log).alias("score")
    )


def op6_lm_score(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
