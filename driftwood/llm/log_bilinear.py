"""Language-model scores from a log-bilinear model over word classes, trained by noise-contrastive estimation."""

from __future__ import annotations

import math
import sys
import zlib
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwood.llm.common import fold, groups_in, parts_of
from driftwood.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = 63           # most frequent words, a class of their own each, at least
BUCKETS = 32         # classes of the other words, by their last bytes, at least
CLASSES = 1 + WORDS + BUCKETS   # class 0 is the end of a text, and also stands before its first word
GROWTH = 8           # classes for each fourth root of the distinct words, above ``CLASSES``
WIDTH = 24           # of a class's vectors
STEPS = 2500         # of training, for each shard of the table of runs
BATCH = 1024         # runs drawn for a step
AHEAD = 64           # steps whose runs are drawn at once
DRAWS = 2            # runs drawn in training for each row of the table of runs, at least
SHARD_RUNS = STEPS * BATCH // DRAWS   # rows of a shard, about
ROUNDS = 10          # of training, if there are several shards; behind each their parameters are averaged
ENDING = 3
TOP = 65_536         # frequent words, at most, whose counts each task gets
TOP_BYTES = 64       # a longer word is looked up like a rare one
HELD_WORDS = 500_000   # distinct words that a counting task holds before it hands them on
HELD_RUNS = 2_000_000  # and distinct runs
HANDED = 65_536        # rows that it hands on at once
LOG10 = np.log(10.0)


def tokens(text: str) -> list[bytes]:
    """Words in UTF-8, A to Z in lower case, cut at ASCII white space."""
    return text.encode().lower().split()


def class_numbers(types: int) -> tuple[int, int]:
    """Words with a class of their own, and buckets of the others, for a number of distinct words.

    Classes grow with the fourth root, so that the runs of three grow slower than the distinct words.
    """
    classes = max(CLASSES, math.floor(GROWTH * types**0.25))
    words = (classes - 1) * WORDS // (WORDS + BUCKETS)
    return words, classes - 1 - words


def bucket_of(word: bytes, buckets: int = BUCKETS) -> int:
    return zlib.crc32(word[-ENDING:]) % buckets


def bucket_column(word: Column, buckets: int = BUCKETS) -> Column:
    binary = word.cast("binary")
    ending = F.substring(binary, F.greatest(F.octet_length(binary) - F.lit(ENDING - 1), F.lit(1)), F.lit(ENDING))
    return F.pmod(F.crc32(ending), F.lit(buckets)).cast("int")


def _counted(batches):
    def rows_of(counts):
        given = iter(counts.items())
        while some := list(islice(given, HANDED)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], names=["word", "n"])

    counts: Counter = Counter()
    for batch in batches:
        for _, texts in parts_of(batch):
            for text in texts:
                counts.update(tokens(text))
        if len(counts) > HELD_WORDS:
            yield from rows_of(counts)
            counts = Counter()
    yield from rows_of(counts)


def _classed(classes: dict[bytes, int], words: list[bytes], known: dict[bytes, int], numbers: tuple[int, int]) -> list[int]:
    if len(known) > 200_000:
        known.clear()
        known.update(classes)
    try:
        return [known[w] for w in words]
    except KeyError:
        for w in words:
            if w not in known:
                known[w] = 1 + numbers[0] + bucket_of(w, numbers[1])
        return [known[w] for w in words]


def _runs(texts: list[str], classes, known, numbers) -> tuple[np.ndarray, np.ndarray]:
    """Class numbers of all three-word runs, ``(before, last, next)``, and how many each text has."""
    flat, lengths = [], []
    for text in texts:
        found = _classed(classes, tokens(text), known, numbers)
        flat.extend([0, 0])
        flat.extend(found)
        flat.append(0)
        lengths.append(len(found) + 1)
    row, size = np.array(flat, dtype=np.int64), 1 + sum(numbers)
    runs = (row[:-2] * size + row[1:-1]) * size + row[2:] if len(row) > 2 else np.empty(0, np.int64)
    keep = np.ones(len(runs), dtype=bool)
    # Runs over the border of two texts do not count.
    borders = np.cumsum(np.array(lengths[:-1], dtype=np.int64) + 2)
    keep[borders - 2] = False
    keep[borders - 1] = False
    return runs[keep], np.array(lengths)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    runs, place = np.unique(np.concatenate([r for r, _ in parts]), return_inverse=True)
    return runs, np.bincount(place, weights=np.concatenate([n for _, n in parts]), minlength=len(runs)).astype(np.int64)


def _run_counts(batches, classes, numbers):
    def rows_of(held):
        for i in range(0, len(held[0]), HANDED):
            yield pa.RecordBatch.from_arrays([pa.array(h[i:i + HANDED]) for h in held], names=["run", "n"])

    known, held, parts, waiting = dict(classes), (np.empty(0, np.int64), np.empty(0, np.int64)), [], 0
    for batch in batches:
        for _, texts in parts_of(batch):
            parts.append(np.unique(_runs(texts, classes, known, numbers)[0], return_counts=True))
            waiting += len(parts[-1][0])
            if waiting > HELD_RUNS // 2:
                held, parts, waiting = _merged([held, *parts]), [], 0
            if len(held[0]) > HELD_RUNS:
                yield from rows_of(held)
                held = held[0][:0], held[1][:0]
    yield from rows_of(_merged([held, *parts]))


def _views(flat: np.ndarray, classes: int, width: int) -> dict[str, np.ndarray]:
    """The parameters as arrays over one flat vector."""
    shapes, found, at = {"context": (classes, width), "target": (classes, width), "far": (width, width), "near": (width, width), "bias": (classes,)}, {}, 0
    for name, shape in shapes.items():
        found[name] = flat[at:at + math.prod(shape)].reshape(shape)
        at += math.prod(shape)
    return found


def started(frequency: np.ndarray, width: int = WIDTH, seed: int = 1) -> np.ndarray:
    """Parameters before training, and the means of their gradients and of the gradients' squares: three flat vectors."""
    generator, classes = np.random.default_rng(seed), len(frequency)
    parts = [generator.normal(0, 0.1, 2 * classes * width), np.eye(width).ravel() * 0.5, np.eye(width).ravel() * 0.5, np.log(frequency)]
    state = np.zeros((3, sum(map(len, parts))))
    state[0] = np.concatenate(parts)
    return state


def learned(state: np.ndarray, runs: np.ndarray, counts: np.ndarray, frequency: np.ndarray, first: int, last: int, steps: int, width: int = WIDTH,
            noise: int = 10, batch: int = BATCH, seed: int = 1, shard: int = 0) -> np.ndarray:
    """The state after steps ``first`` to ``last`` of ``steps`` on some runs.

    The next class is predicted from a context's vectors, each turned by a matrix of its place: score = prediction .
    target + bias. Noise-contrastive estimation tells the observed next class from ``noise`` ones drawn by their
    frequency, in minibatches drawn by the runs' counts. Scores and gradients are batched matrix products.
    """
    generator, classes = np.random.default_rng([seed, shard, first]), len(frequency)
    drawn = np.cumsum(counts) / counts.sum()
    offset = np.log(noise * frequency).astype(np.float32)
    state = state.astype(np.float32)
    values, mean, square = state
    p = _views(values, classes, width)
    rows = np.arange(batch)[:, None]
    for step in range(first + 1, last + 1):
        at = (step - first - 1) % AHEAD
        if not at:
            # Runs and noise of the next steps: looked up in order, then shuffled.
            n = batch * min(AHEAD, last + 1 - step)
            ahead = generator.permutation(runs[np.minimum(np.searchsorted(drawn, np.sort(generator.random(n))), len(runs) - 1)]).reshape(-1, batch)
            noise_ahead = generator.permutation(np.repeat(np.arange(classes), generator.multinomial(n * noise, frequency))).reshape(-1, batch, noise)
        chosen, others = ahead[at], noise_ahead[at]
        a, b, c = chosen // classes**2, chosen // classes % classes, chosen % classes
        far, near = p["context"][a], p["context"][b]
        prediction = far @ p["far"] + near @ p["near"]
        picked = np.concatenate([c[:, None], others], axis=1)
        data = 1 / (1 + np.exp(np.clip((prediction @ p["target"].T)[rows, picked] + (p["bias"] - offset)[picked], -30, 30)))
        # data: chance that the class is noise. The error pulls the observed class up and the drawn ones down.
        data[:, 1:] -= 1
        error = np.zeros(batch * classes, dtype=np.float32)
        np.add.at(error, (rows * classes + picked).ravel(), data.ravel() / batch)
        error = error.reshape(batch, classes)
        back = error @ p["target"]
        context = _summed(a, back @ p["far"].T, classes) + _summed(b, back @ p["near"].T, classes)
        gradient = np.concatenate([part.ravel() for part in (context, error.T @ prediction, far.T @ back, near.T @ back, error.sum(axis=0))])
        rate = 0.02 * (1 - step / (steps + 1))
        mean += 0.1 * (gradient - mean)
        square += 0.001 * (gradient**2 - square)
        values += rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return state.astype(np.float64)


def _summed(rows: np.ndarray, values: np.ndarray, classes: int) -> np.ndarray:
    """Sums of the values' rows by class."""
    width = values.shape[1]
    return np.bincount((rows[:, None] * width + np.arange(width)).ravel(), values.ravel(), classes * width).astype(np.float32)


def finished(state: np.ndarray, classes: int, width: int = WIDTH) -> dict[str, np.ndarray]:
    """Vectors of the contexts' two places, targets, biases, and the logarithm of each context's sum of scores."""
    p = _views(state[0], classes, width)
    far, near, norm = p["context"] @ p["far"], p["context"] @ p["near"], []
    for one in far:
        scores = (one + near) @ p["target"].T + p["bias"]
        most = scores.max(axis=1)
        norm.append(most + np.log(np.exp(scores - most[:, None]).sum(axis=1)))
    return {"far": far, "near": near, "target": p["target"], "bias": p["bias"], "norm": np.concatenate(norm)}


def _frequency(following: np.ndarray) -> np.ndarray:
    return (following + 0.5) / (following + 0.5).sum()


def fit(runs: np.ndarray, counts: np.ndarray, classes: int = CLASSES, steps: int = STEPS, **settings) -> dict[str, np.ndarray]:
    """The model of a table of runs at hand."""
    frequency = _frequency(np.bincount(runs % classes, weights=counts, minlength=classes))
    return finished(learned(started(frequency), runs, counts, frequency, 0, steps, steps, **settings), classes)


def log_chances(model: dict[str, np.ndarray], runs: np.ndarray) -> np.ndarray:
    """log10 of the chance of each run's last class behind the two others."""
    classes = len(model["bias"])
    context, following = runs // classes, runs % classes
    prediction = model["far"][context // classes] + model["near"][context % classes]
    scores = np.einsum("ij,ij->i", prediction, model["target"][following]) + model["bias"][following]
    return (scores - model["norm"][context]) / LOG10


def train(runs: np.ndarray, counts: np.ndarray, **settings) -> np.ndarray:
    """The table of log10 probabilities, one row per context of two classes, each row summing up to one."""
    model = fit(runs, counts, **settings)
    classes = len(model["bias"])
    return log_chances(model, np.arange(classes**3)).reshape(classes**2, classes)


def _sharded(batches):
    """One row for each shard of the table of runs: in order, steps between runs and their counts, packed."""
    for table in groups_in(batches, ["shard"]):
        runs, counts = (table.column(c).to_numpy().astype(np.int64) for c in ("run", "n"))
        yield pa.RecordBatch.from_arrays(
            [table.column("shard").slice(0, 1).combine_chunks(), *(pa.array([zlib.compress(c.tobytes(), 1)], pa.binary()) for c in (np.diff(runs, prepend=0), counts))],
            names=["shard", "runs", "counts"])


def _learned(batches, state: np.ndarray, frequency: np.ndarray, first: int, last: int):
    for batch in batches:
        for shard, *columns in zip(*(batch.column(c) for c in ("shard", "runs", "counts"))):
            steps, counts = (np.frombuffer(zlib.decompress(c.as_buffer()), dtype=np.int64) for c in columns)
            after = learned(state, np.cumsum(steps), counts, frequency, first, last, STEPS, shard=shard.as_py())
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard.as_py()], pa.int32()), pa.array([float(counts.sum())]), pa.array([after.tobytes()], pa.binary())], names=["shard", "weight", "state"])


def _mean_state(weights: list[float], states: list[bytes]) -> np.ndarray:
    return sum(w / sum(weights) * np.frombuffer(s) for w, s in zip(weights, states)).reshape(3, -1)


def _averaged(batches):
    for table in groups_in(batches, ["part"]):
        weights = table.column("weight").to_pylist()
        mean = _mean_state(weights, table.column("state").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [table.column("part").slice(0, 1).combine_chunks(), pa.array([sum(weights)]), pa.array([mean.tobytes()], pa.binary())], names=["part", "weight", "state"])


def train_shards(runs: DataFrame, classes: int, label: str = "log-bilinear") -> dict[str, np.ndarray]:
    """The model of a written table of runs ``(run, n)``, trained by as many tasks as its rows ask for.

    The table is dealt into shards of about ``SHARD_RUNS`` rows by the runs' hashes. In each of ``ROUNDS`` rounds every
    shard goes on from the same state by its part of ``STEPS`` steps on its own runs, and the states are averaged by
    the shards' counts. So a task holds one shard, the steps follow the rows, and only averages reach the driver.
    """
    following = np.zeros(classes)
    for r in runs.groupBy((F.col("run") % classes).alias("last")).agg(F.sum("n").alias("n")).collect():
        following[r["last"]] = r["n"]
    frequency = _frequency(following)
    state, shards = started(frequency), math.ceil(runs.count() / SHARD_RUNS)
    if not shards:
        return finished(np.zeros_like(state), classes)
    dealt = runs.withColumn("shard", F.pmod(F.xxhash64("run"), F.lit(shards)).cast("int"))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "run")
    dealt = materialise(dealt.mapInArrow(_sharded, "shard int, runs binary, counts binary"), label)
    rounds, parts = ROUNDS if shards > 1 else 1, math.isqrt(shards)
    for k in range(rounds):
        first, last = STEPS * k // rounds, STEPS * (k + 1) // rounds
        after = dealt.mapInArrow(
            lambda b, s=state, x=first, y=last: _learned(b, s, frequency, x, y), "shard int, weight double, state binary")
        after = after.withColumn("part", F.col("shard") % parts).repartition(parts, "part").sortWithinPartitions("part", "shard")
        found = sorted(after.mapInArrow(_averaged, "part int, weight double, state binary").collect())
        state = _mean_state([r["weight"] for r in found], [r["state"] for r in found])
    return finished(state, classes)


def _scored(batches, shared):
    """Per text what the classes and the frequent words give, and the other words with their numbers."""
    held = shared.value
    classes, top, model, numbers = held["classes"], held["top"], held["model"], held["numbers"]
    total, spread = held["total"], held["spread"]
    known = dict(classes)
    # What a frequent word adds: to the base score, and to the model's within its class.
    adds = {w: (np.log10((n + 0.5) / total), 0.0 if w in classes else np.log10((n + 0.5) / spread[bucket_of(w, numbers[1])])) for w, n in top.items()}
    nothing = len(adds)
    place = {w: i for i, w in enumerate(adds)}
    of_base, of_words = (np.array([*(a[k] for a in adds.values()), 0.0]) for k in (0, 1))
    number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
    for batch in batches:
        for part, some in parts_of(batch):
            runs, lengths = _runs(some, classes, known, numbers)
            starts = np.cumsum(lengths) - lengths
            by_class = np.add.reduceat(log_chances(model, runs), starts)
            words = [tokens(t) for t in some]
            base, within, rare, n_known = [], [], [], []
            look = place.get
            for found in words:
                places = np.array([look(w, nothing) for w in found], dtype=np.int64)
                base.append(held["end"] + of_base[places].sum())
                within.append(of_words[places].sum())
                n_known.append(held["known_end"] + int((places < nothing).sum()))
                rare.append(list(Counter([found[i].decode() for i in np.flatnonzero(places == nothing).tolist()]).items()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(number + np.arange(len(some))), part.column("id"), pa.array(lengths.astype(np.int64)),
                 pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(by_class + np.array(within)),
                 pa.array(rare, pa.map_(pa.string(), pa.int64()))],
                names=["row", "id", "n_tokens", "n_known", "base_score", "score", "rare"])
            number += len(some)


def language_scores(docs: DataFrame, learn: Column, key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    Learns from the rows for which ``learn`` holds and scores all. A text is its words, A to Z in lower case, and one
    end; null texts are empty and consist of their end. ``base_score`` is log10 of a smoothed count model, ``score``
    the log10 probability of the log-bilinear model: the probability of the next word's class, given the classes of
    the two before, times that of the word within its class by smoothed counts, an unseen word being one more type of
    its class. Both are normalised.

    All words of the learning rows are counted, and all runs of three classes. Classes grow with the distinct words
    (``class_numbers``), and tasks train on shards of the table of runs, in steps that follow its rows. Frequent words are scored where the text lies;
    the others, distinct in each text, meet their counts in one join, where no key is frequent.
    """
    spark, label = docs.sparkSession, "log-bilinear"
    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(F.col(key).alias("id"), F.col("text").cast("string").alias("text"))
    training = docs.filter(learn).select(F.col("text").cast("string").alias("text"))
    counts = training.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialise(counts, label)
    ends = training.count()
    numbers = class_numbers(counts.count())
    of_bucket = counts.groupBy(bucket_column(F.col("word"), numbers[1]).alias("bucket")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect()
    n_words, n_types = sum(r["n"] for r in of_bucket), sum(r["types"] for r in of_bucket)
    # Words by steps of a sixteenth of a power of two, from the most frequent down to the last step that fits ``TOP``.
    step = F.floor(F.log2("n") * 16)
    short = F.octet_length("word") <= TOP_BYTES
    steps = counts.filter(short).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, room = 1 << 30, TOP
    for r in sorted(steps, key=lambda r: -r["step"]):
        room -= r["n"]
        if room < 0:
            break
        least = r["step"]
    is_top = short & (step >= least)
    frequent = sorted(counts.filter(is_top).collect(), key=lambda r: (-r["n"], r["word"].encode()))
    top = {r["word"].encode(): r["n"] for r in frequent}
    classes = {w: i + 1 for i, w in enumerate(list(top)[:numbers[0]])}
    runs = training.mapInArrow(lambda b: _run_counts(b, classes, numbers), "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))
    model = train_shards(materialise(runs, label), 1 + sum(numbers), label)
    # Words with a class of their own are not part of their bucket.
    size, types = np.zeros(numbers[1]), np.zeros(numbers[1])
    for r in of_bucket:
        size[r["bucket"]], types[r["bucket"]] = r["n"], r["types"]
    for w in classes:
        size[bucket_of(w, numbers[1])] -= top[w]
        types[bucket_of(w, numbers[1])] -= 1
    spread = size + 0.5 * (types + 1)
    n_tokens, distinct = n_words + ends, n_types + (1 if ends else 0)
    total = n_tokens + 0.5 * (distinct + 1)
    shared = spark.sparkContext.broadcast({
        "classes": classes, "top": top, "model": model, "numbers": numbers, "total": total, "spread": spread,
        "end": float(np.log10((ends + 0.5) / total)), "known_end": int(ends > 0)})
    scored = given.mapInArrow(
        lambda b: _scored(b, shared), f"row long, id {kind}, n_tokens long, n_known long, base_score double, score double, rare map<string,long>")
    scored = materialise(scored, label)
    rare = scored.select("row", F.explode("rare").alias("word", "times"))
    # Rare words are those behind the frequent ones, and long ones of any number.
    others = counts.filter(~is_top)
    seen = F.coalesce(F.col("n"), F.lit(0))
    within = F.element_at(F.array(*[F.lit(float(s)) for s in spread]), bucket_column(F.col("word"), numbers[1]) + 1)
    more = (
        rare.join(others, "word", "left").groupBy("row")
        .agg(F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("more_known"),
             F.sum(F.col("times") * F.log10((seen + 0.5) / F.lit(total))).alias("more_base"),
             F.sum(F.col("times") * F.log10((seen + 0.5) / within)).alias("more_score"))
    )
    none = F.lit(0.0)
    return scored.drop("rare").join(materialise(more, label), "row", "left").select(
        "id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", none)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", none)).alias("score"))


def held_out(key: Column, folds: int = 5, fold_out: int = 1) -> Column:
    """True for the ids of the fold that is not learned from."""
    return fold(key, folds) == fold_out
