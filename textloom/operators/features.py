"""TF-IDF with sublinear counts, smoothed inverse frequencies and unit length, and linear classifiers over it."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StringIndexer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from textloom.sources.io import exists

from . import svm
from .metrics import summary
from .quota import seeded, seeded_rank

_TOKEN = r"([\p{L}\p{N}_]{2,})"
#: Distinct terms that a task holds before it hands its counts on; texts, and about how many bytes of them, that it works on at once; bits of a bucket.
_HELD, _TEXTS, _BYTES, _BITS = 1 << 20, 512, 1 << 20, 22
#: Occurrences in a bucket are exchanged as 32 bits; more than this many count as this many.
_MOST = (1 << 31) - 1


def terms(c: Column) -> Column:
    """Words of two or more characters, then pairs of neighbours."""
    w = F.regexp_extract_all(F.lower(c), F.lit(_TOKEN), F.lit(1))
    pairs = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(w, F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>")))


_WORD = re.compile(r"\w{2,}")


def counted(text: str) -> Counter[str]:
    """``terms`` of one text and how often each comes."""
    w = _WORD.findall(text.lower())
    return Counter(chain(w, map(" ".join, pairwise(w))))


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``_TEXTS`` rows and about ``_BYTES`` of their last column, the texts."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < len(ends):
            full = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _BYTES, "right"))
            stop = min(max(full, start + 1), start + _TEXTS, len(ends))
            yield batch.slice(start, stop - start)
            start = stop


@cache
def _in_words() -> np.ndarray:
    """Of each code point, whether words may hold it."""
    return np.fromiter((c == "_" or c.isalnum() for c in map(chr, range(0x110000))), bool, 0x110000)


def worded(texts: list[str | None]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of all texts, what ``_WORD`` finds in them, each distinct one made once; and how many each text has."""
    lower = [t.lower() if t else "" for t in texts]
    points = np.frombuffer(" ".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, lower), np.int64, len(lower)) + 1)
    on = _in_words()[points]
    before, after = np.append(False, on[:-1]), np.append(on[1:], False)
    kept = on & (before | after)
    first, last = np.flatnonzero(kept & ~before), np.flatnonzero(kept & ~after)
    sizes = np.diff(np.searchsorted(first, ends), prepend=0)
    points = points[kept]
    letters = points.tobytes().decode("utf-32-le").encode()
    starts = np.append(0, np.cumsum(last - first + 1))
    if len(letters) > len(points):
        wide = [np.append(0, np.cumsum(points >= least, dtype=np.int32)) for least in (0x80, 0x800, 0x10000)]
        starts = starts + sum(w[starts] for w in wide)
    starts = starts.astype(np.int32)
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(starts), pa.py_buffer(letters)).dictionary_encode(), sizes


def coded(texts: list[str | None], number: Callable[[pa.StringArray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Code of each term of each text, and the text's place: a word's number in the upper half; for a pair, the second's and one in the lower.

    ``number`` gets each distinct word once. Terms with a word whose number is negative are left out.
    """
    words, sizes = worded(texts)
    ids = number(words.dictionary)[words.indices.to_numpy()]
    at = np.repeat(np.arange(len(texts)), sizes)
    pair = np.flatnonzero((at[1:] == at[:-1]) & (ids[1:] >= 0) & (ids[:-1] >= 0))
    one = np.flatnonzero(ids >= 0)
    return np.concatenate([ids[one] << 32, (ids[pair] << 32) + ids[pair + 1] + 1]), np.concatenate([at[one], at[pair]])


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes as they first come, and the place of each among them."""
    found = pa.array(codes).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def _hashed(words: pa.StringArray) -> np.ndarray:
    """31 bits of each word, which is not empty; the same in every task."""
    if not len(words):
        return np.zeros(0, np.int64)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    letters = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    starts, sizes = ends[:-1] - ends[0], np.diff(ends)
    powers = np.cumprod(np.full(sizes.max(), 0x9E3779B97F4A7C15, np.uint64))
    mixed = np.add.reduceat(letters * powers[np.arange(len(letters)) - np.repeat(starts, sizes)], starts)
    return (mixed >> np.uint64(33)).astype(np.int64)


def _buckets(codes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Two independent buckets of each code of hashed words, one after the other."""
    for m in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        x = codes.astype(np.uint64) * np.uint64(m)
        yield ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)


def _bounds(texts: DataFrame) -> np.ndarray:
    """Occurrences by bucket, two rows: neither row's is below the occurrences of any term in it."""
    bits = _BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << bits), np.int64)
        for batch in sliced(batches):
            for row, own in zip(total, _buckets(coded(batch.column(0).to_pylist(), _hashed)[0], bits), strict=True):
                np.add.at(row, own, 1)
        for part, own in enumerate(total.reshape(-1, 1 << 16)):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.minimum(own, _MOST).astype(np.int32).tobytes()], pa.binary())], names=["part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held[part] = held.get(part, 0) + np.frombuffer(own.as_py(), np.int32).astype(np.int64)
        for part, own in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.minimum(own, _MOST).astype(np.int32).tobytes()], pa.binary())], names=["part", "sums"])

    schema, cores = "part int, sums binary", texts.sparkSession.sparkContext.defaultParallelism
    found = texts.coalesce(cores).mapInArrow(count, schema).repartition(8, "part").mapInArrow(add, schema).toArrow()
    out = np.zeros((2 << bits >> 16, 1 << 16), np.int32)
    for part, own in zip(found.column("part").to_pylist(), found.column("sums"), strict=True):
        out[part] = np.frombuffer(own.as_buffer(), np.int32)
    return out.reshape(2, -1)


def _counts(texts: DataFrame, hot: np.ndarray | None) -> DataFrame:
    """(term, df, total) of the terms whose buckets are ``hot`` in both rows; of all, if it is None."""
    bits = _BITS
    shared = None if hot is None else texts.sparkSession.sparkContext.broadcast(np.packbits(hot, axis=1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None if shared is None else np.unpackbits(shared.value, axis=1).astype(bool)
        numbers: defaultdict[str, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        hashes, none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, fresh, waiting = (none, none, none), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            codes, place = _distinct(np.concatenate([held[0], *(x[0] for x in fresh)]))
            return codes, *(np.bincount(place, np.concatenate([held[i], *(x[i] for x in fresh)]), len(codes)).astype(np.int64) for i in (1, 2))

        def handed(codes: np.ndarray, has: np.ndarray, total: np.ndarray) -> Iterator[pa.RecordBatch]:
            names = pa.array(list(numbers), pa.string())
            for i in range(0, len(codes), 1 << 16):
                own = codes[i : i + (1 << 16)]
                first, second = own >> 32, (own & 0xFFFFFFFF) - 1
                one = names.take(pa.array(first))
                two = pc.binary_join_element_wise(one, names.take(pa.array(np.maximum(second, 0))), " ")
                terms_ = pc.if_else(pa.array(second < 0), one, two)
                yield pa.RecordBatch.from_arrays([terms_, pa.array(has[i : i + (1 << 16)]), pa.array(total[i : i + (1 << 16)])], names=["term", "df", "total"])

        for batch in sliced(batches):
            codes, at = coded(batch.column(0).to_pylist(), lambda w: np.fromiter(map(numbers.__getitem__, w.to_numpy(zero_copy_only=False)), np.int64, len(w)))
            if open_ is not None:
                hashes = np.append(hashes, _hashed(pa.array(list(islice(numbers, len(hashes), None)), pa.string())))
                first, second = codes >> 32, (codes & 0xFFFFFFFF) - 1
                one, two = _buckets((hashes[first] << 32) + np.where(second < 0, 0, hashes[np.maximum(second, 0)] + 1), bits)
                on = open_[0, one] & open_[1, two]
                codes, at = codes[on], at[on]
            codes, place = _distinct(codes)
            once = _distinct(at * len(codes) + place)[0]
            fresh.append((codes, np.bincount(once % max(len(codes), 1), minlength=len(codes)), np.bincount(place, minlength=len(codes))))
            waiting += len(codes)
            full = len(numbers) > _HELD
            if full or waiting > len(held[0]) + (1 << 18):
                held, fresh, waiting = merged(), [], 0
                if full or len(held[0]) > _HELD:
                    yield from handed(*held)
                    held, hashes = (none, none, none), none
                    numbers.clear()
        yield from handed(*merged())

    parts = texts.mapInArrow(count, "term string, df long, total long")
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def vocabulary(df: DataFrame, size: int = 50_000, least: int = 2) -> DataFrame:
    """(term, df) of the ``size`` most frequent terms that ``least`` texts have; ties by term.

    Most pairs of words are rare. A first pass sums occurrences in hashed buckets, which bound every term's from
    above; only terms whose bounds reach a guess of the last place's count are counted, exactly, and exchanged. If
    fewer than ``size`` of them reach the guess, it was too high and is lowered.
    """
    texts = df.select("text")
    bounds = _bounds(texts)
    place = min(2 * size, bounds.shape[1])
    guess = int(np.partition(bounds[0], -place)[-place])
    while guess > 1:
        found = _counts(texts, bounds >= guess).where(F.col("df") >= least)
        kept = found.where(F.col("total") >= guess).orderBy(F.desc("total"), "term").limit(size).select("term", "df").collect()
        if len(kept) == size:
            return df.sparkSession.createDataFrame(pa.table({"term": pa.array([r["term"] for r in kept], pa.string()), "df": pa.array([r["df"] for r in kept], pa.int64())}))
        guess //= 2
    return _counts(texts, None).where(F.col("df") >= least).orderBy(F.desc("total"), "term").limit(size).select("term", "df")


def weigher(found: list[tuple[str, int]], n: int) -> Callable[[list[str | None]], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of (term, df) of a vocabulary learnt from ``n`` texts: what gives text, place and weight of each term that a text has, in that order."""
    numbers: dict[str, int] = {}
    codes = np.zeros(len(found), np.int64)
    for i, (term, _) in enumerate(found):
        own = [numbers.setdefault(w, len(numbers)) for w in term.split(" ")]
        codes[i] = (own[0] << 32) + (own[1] + 1 if len(own) > 1 else 0)
    known, idf = pa.array(list(numbers), pa.string()), np.log((1.0 + n) / (1 + np.array([d for _, d in found], float))) + 1

    def weigh(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        own, at = coded(texts, lambda w: pc.fill_null(pc.index_in(w, known), -1).to_numpy().astype(np.int64))
        place = pc.fill_null(pc.index_in(pa.array(own), pa.array(codes)), -1).to_numpy()
        on = place >= 0
        key, times = np.unique(at[on] * len(codes) + place[on], return_counts=True)
        at, place = np.divmod(key, len(codes))
        weight = (1 + np.log(times)) * idf[place]
        norm = np.sqrt(np.bincount(at, weight**2, len(texts)))
        return at, place, weight / norm[at]

    return weigh


def tfidf(df: DataFrame, terms_: DataFrame, n: int) -> DataFrame:
    """(row_id, term, weight) of each text's own terms; ``n``: texts that the vocabulary was learnt from.

    The vocabulary, bounded by its size, goes out once; counts and norms are made in the row, without an exchange.
    """
    shared = df.sparkSession.sparkContext.broadcast([(r["term"], r["df"]) for r in terms_.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh, names = weigher(shared.value, n), pa.array([t for t, _ in shared.value], pa.string())
        for batch in sliced(batches):
            at, place, weight = weigh(batch.column(1).to_pylist())
            for i in range(0, max(len(at), 1), 1 << 17):
                some = slice(i, i + (1 << 17))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[some])).cast(pa.int64()), names.take(pa.array(place[some])), pa.array(weight[some])], names=["row_id", "term", "weight"])

    return df.select("row_id", "text").mapInArrow(run, "row_id long, term string, weight double")


def save_features(table: DataFrame, root: str, key: str, part: str) -> None:
    """Keeps a prepared table under the key of what it was made from."""
    table.write.mode("overwrite").parquet(f"{root.rstrip('/')}/tfidf-{key}-{part}.parquet")


def load_features(spark: SparkSession, root: str, key: str, part: str, rows: int) -> DataFrame | None:
    """The kept table, or None if there is none or it has another number of rows."""
    path = f"{root.rstrip('/')}/tfidf-{key}-{part}.parquet"
    if not exists(spark, path):
        return None
    table = spark.read.parquet(path)
    return table if table.count() == rows else None


def cache_key(train: DataFrame, test: DataFrame) -> str:
    """12 hex digits over the row counts and the ends of the first and last training text."""
    ends = train.agg(F.count("*").alias("n"), F.min_by("text", "row_id").alias("a"), F.max_by("text", "row_id").alias("b"))
    both = ends.crossJoin(test.agg(F.count("*").alias("m")))  # one row and one row
    return both.select(F.substring(F.md5(F.concat_ws("|", "n", "m", F.substring("a", 1, 100), F.substring("b", 1, 100))), 1, 12).alias("key")).first()["key"]


def vectorizer(size: int = 50_000, least: int = 2):
    """Fits the vocabulary on train; returns its terms and a function that puts ``places`` and ``values`` for any table's text.

    The vocabulary, bounded by ``size``, goes out once; what the function makes stays where the rows are. Its
    ``vectors`` does the same to the batches of a task.
    """

    def fit(train: DataFrame):
        held = [(r["term"], r["df"]) for r in vocabulary(train, size, least).collect()]
        n = train.count()
        shared = train.sparkSession.sparkContext.broadcast(held)

        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weigh = weigher(shared.value, n)
            for batch in sliced(batches):
                at, place, weight = weigh(batch.column(batch.num_columns - 1).to_pylist())
                ends = np.append(0, np.cumsum(np.bincount(at, minlength=len(batch)))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x, kind)) for x, kind in ((place.astype(np.int32), pa.int32()), (weight, pa.float64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *lists], names=[*batch.schema.names[:-1], "places", "values"])

        def transform(table: DataFrame) -> DataFrame:
            kept = [c for c in table.columns if c != "text"]
            schema = StructType([table.schema[c] for c in kept]).add("places", ArrayType(IntegerType())).add("values", ArrayType(DoubleType()))
            return table.select(*kept, "text").mapInArrow(vectors, schema)

        transform.vectors = vectors
        return [t for t, _ in held], transform

    return fit


def index_labels(train: DataFrame, column: str = "label"):
    """Labels in alphabetical order; unseen ones are an error."""
    return StringIndexer(inputCol=column, outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="error").fit(train)


def folds(df: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """Adds a fold by class in seeded order."""
    return seeded_rank(df, ["label"], seeded(seed, "row_id")).withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank")


#: At which the optimisers end, as the scripts' library has it by default.
TOLERANCE = 1e-4
#: Rows of a task of the optimisers, at least: each sends sums as wide as the vocabulary, so there are no more tasks than cores.
_ROWS = 2000
#: Values of the grid (inverse penalties; smoothings), folds, and the value without a search.
GRIDS = {"svm": [0.01, 0.1, 1.0, 10.0], "logreg": [0.01, 0.1, 1.0, 10.0], "nb": [0.01, 0.1, 0.5, 1.0]}
FOLDS, PENALTY = 3, 1.0


def classifier(kind: str, search: bool) -> list[float]:
    """The values of 'svm', 'logreg' or 'nb' that are tried."""
    if kind not in GRIDS:
        raise ValueError(f"unknown classifier: {kind}")
    return GRIDS[kind] if search else [PENALTY]


def evaluate(kind: str, train: DataFrame, test: DataFrame, *, search: bool = False, size: int = 50_000, iterations: int = 1000) -> DataFrame:
    """(name, balanced_accuracy, macro_f1) of a classifier on test, with a grid search over three folds on request.

    All values and folds of the grid go through the same passes, then the best value is fitted on all rows.
    """
    grid = classifier(kind, search)
    indexer = index_labels(train)
    terms_, transform = vectorizer(size)(train)
    size, n, classes = len(terms_), train.count(), len(indexer.labels)
    train, test = (indexer.transform(x).select("row_id", "text", F.col("label_index").cast("int").alias("label")) for x in (train, test))
    # Texts are dealt once, by class and seeded order, and made into vectors where they then are.
    tasks = max(1, min(n // _ROWS, train.sparkSession.sparkContext.defaultParallelism))
    held = folds(train, FOLDS).coalesce(tasks) if search else train.withColumn("fold", F.lit(0)).repartition(tasks)
    rows = transform(held.select("label", "fold", "text")).persist()
    try:
        given = {"tolerance": TOLERANCE, "iterations": iterations}
        if kind == "nb":
            given["sums"] = svm.class_sums(rows, size, classes)
        # The last fit starts at the mean of the folds' weights; what it ends at is the whole table's.
        best, first = svm.searched(rows, size, classes, grid, FOLDS, svm.macro_f1, kind=kind, **given) if search else (grid[0], None)
        weights = svm.train(kind, rows, size, classes, [(best, -1)], first=first, **given)
    finally:
        rows.unpersist()
    asked = test.select("label", F.lit(-1).alias("fold"), "text")
    scored = svm.predictions(asked, size, weights, held_out=False, made=transform.vectors).select("label", "prediction")
    return summary(scored).select(F.lit(kind).alias("name"), F.round("balanced_accuracy", 4).alias("balanced_accuracy"), F.round("macro_f1", 4).alias("macro_f1"))
