"""Tensors and detections: classification heads, quantisation, layouts, dense layers, anchor decoding, suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.catalog import query, table


def embeddings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def softmax(v: Column) -> Column:
    """Probabilities of an array of logits; an empty array or one with a value that isn't finite is an error."""
    bad = (F.size(v) == 0) | F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    shares = lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total))
    out = let(F.array_max(v).cast("double"), lambda top: let(F.transform(v, lambda x: F.exp(x.cast("double") - top)), shares))
    return F.when(bad, F.raise_error(F.lit("logits must be finite")).cast("array<double>")).otherwise(out)


def argmax(v: Column) -> Column:
    """The place of the first maximum, from 0."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("long")


@query("k_tensorpostprocess", "WITH x AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), m AS (SELECT vec_id, max(v) AS m FROM x GROUP BY vec_id), e AS (SELECT vec_id, i, exp(v - m) AS e, v = m AS top FROM x JOIN m USING (vec_id)) SELECT vec_id, CAST(min(CASE WHEN top THEN i END) AS BIGINT) AS class, round(max(e) / sum(e), 6) AS p FROM e GROUP BY vec_id")
def k_tensorpostprocess(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return e.select("vec_id", argmax(F.col("embedding")).alias("class"), F.round(F.array_max(softmax(F.col("embedding"))), 6).alias("p"))


def quantized(x: Column, scale: float, zero: int, low: int = -128, high: int = 127) -> Column:
    x = x.cast("double") / (scale or 1.0)
    rounded = F.when(x >= 0, F.floor(x + 0.5)).otherwise(F.ceil(x - 0.5))
    return F.greatest(F.lit(low), F.least(F.lit(high), rounded + zero)).cast("long")


def dequantized(q: Column, scale: float, zero: int) -> Column:
    return (q - zero).cast("double") * (scale or 1.0)


@query("k_tensorconvert", "WITH x AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) / 0.02::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), q AS (SELECT vec_id, i, greatest(-128, least(127, CASE WHEN v >= 0 THEN CAST(floor(v + 0.5) AS BIGINT) ELSE CAST(ceil(v - 0.5) AS BIGINT) END + 3)) AS q FROM x) SELECT vec_id, CAST(i AS INTEGER) AS i, q, round((q - 3) * 0.02::DOUBLE, 6) AS back FROM q")
def k_tensorconvert(spark, sf_dir):
    q = embeddings(spark, sf_dir).select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", "i", quantized(F.col("v"), 0.02, 3).alias("q"))
    return q.withColumn("back", F.round(dequantized(F.col("q"), 0.02, 3), 6))


def nchw_to_nhwc(v: Column, c: int, h: int, w: int) -> Column:
    """The array with the channel last."""
    n = F.sequence(F.lit(0), F.lit(c * h * w - 1))
    return F.transform(n, lambda i: F.get(v, ((i % c) * (h * w) + F.floor(i / c)).cast("int")))


def nhwc_to_nchw(v: Column, c: int, h: int, w: int) -> Column:
    n = F.sequence(F.lit(0), F.lit(c * h * w - 1))
    return F.transform(n, lambda i: F.get(v, ((i % (h * w)) * c + F.floor(i / (h * w))).cast("int")))


@query("k_layout", "WITH x AS (SELECT vec_id, unnest(embedding[1:12]) AS v, generate_subscripts(embedding[1:12], 1) - 1 AS i FROM embeddings) SELECT vec_id, CAST((i % 4) * 3 + i // 4 AS INTEGER) AS at, CAST(v AS DOUBLE) AS v FROM x")
def k_layout(spark, sf_dir):
    v = nchw_to_nhwc(F.slice("embedding", 1, 12), 3, 2, 2)
    return embeddings(spark, sf_dir).select("vec_id", F.posexplode(v).alias("at", "v")).withColumn("v", F.col("v").cast("double"))


def dense(df: DataFrame, vector: str, weights: list[list[float]], bias: list[float], out: str) -> DataFrame:
    """A layer with ReLU; weights are constants of the plan."""
    dot = lambda row: F.aggregate(F.zip_with(vector, F.array(*map(F.lit, row)), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn(out, F.array(*(F.greatest(F.lit(0.0), dot(r) + b) for r, b in zip(weights, bias, strict=True))))


LAYER = [[((3 * o + 5 * i) % 11 - 5) / 10 for i in range(8)] for o in range(4)]


@query("k_inference", "WITH x AS (SELECT vec_id, CAST(unnest(embedding[1:8]) AS DOUBLE) AS v, generate_subscripts(embedding[1:8], 1) - 1 AS i FROM embeddings) SELECT vec_id, CAST(o AS INTEGER) AS o, round(greatest(0.0, sum(v * ((3 * o + 5 * i) % 11 - 5) / 10) + o / 10.0), 6) AS y FROM x, (VALUES (0), (1), (2), (3)) u(o) GROUP BY vec_id, o")
def k_inference(spark, sf_dir):
    e = embeddings(spark, sf_dir).withColumn("x", F.slice("embedding", 1, 8))
    return dense(e, "x", LAYER, [o / 10 for o in range(4)], "y").select("vec_id", F.posexplode("y").alias("o", "y")).withColumn("y", F.round("y", 6))


BOXES_SQL = """boxes AS (SELECT p_partkey % 97 AS frame, p_partkey AS id, CAST(p_size % 3 AS INTEGER) AS label, p_retailprice AS conf,
  (p_partkey * 13) % 60 / 100.0::DOUBLE AS x, (p_partkey * 29) % 60 / 100.0::DOUBLE AS y, 0.2::DOUBLE + p_size / 200.0::DOUBLE AS w, 0.3::DOUBLE AS h FROM part)"""


def boxes(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select((k % 97).alias("frame"), k.alias("id"), (F.col("p_size") % 3).alias("label"), F.col("p_retailprice").alias("conf"), ((k * 13) % 60 / 100.0).alias("x"), ((k * 29) % 60 / 100.0).alias("y"), (0.2 + F.col("p_size") / 200.0).alias("w"), F.lit(0.3).alias("h"))


def iou(a, b) -> Column:
    """Intersection over union of boxes x, y, w, h; 0 without any union. a, b: name to column."""
    over = lambda p, s: F.greatest(F.lit(0.0), F.least(a(p) + a(s), b(p) + b(s)) - F.greatest(a(p), b(p)))
    both = over("x", "w") * over("y", "h")
    union = a("w") * a("h") + b("w") * b("h") - both
    return F.when(union <= 0, 0.0).otherwise(both / union)


#: Boxes of a group that are compared with as many others in one row.
TILE = 1024


def overlaps(df: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """keys, a, b and iou of each two boxes (id, x, y, w, h) of a group that overlap, a < b.

    A group's boxes are dealt by id into tiles, and each two tiles meet in one row, in whatever task: so the pairs, which grow with the square
    of a group, are made by all tasks alike and never held, and what is shuffled is each box once for each tile of its group.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    df = df.dropna(subset=[*keys, "id"])
    counts = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("_n"))
    boxes = df.join(counts, keys).withColumn("_t", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    tiles = boxes.groupBy(*keys, "_n", "_t").agg(F.collect_list(F.struct("id", "x", "y", "w", "h")).alias("_box"))
    sides = tiles.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select(*keys, F.least("_t", "_o").alias("_i"), F.greatest("_t", "_o").alias("_j"), "_t", "_box")
    side = lambda c: F.first(F.when(F.col("_t") == F.col(c), F.col("_box")), ignorenulls=True)
    met = sides.repartition(tasks, *keys, "_i", "_j").groupBy(*keys, "_i", "_j").agg(side("_i").alias("_left"), side("_j").alias("_right"))
    met = met.select(*keys, "_i", "_j", F.explode("_left").alias("_a"), "_right").select(*keys, "_i", "_j", "_a", F.explode("_right").alias("_b"))
    once = met.where((F.col("_i") < F.col("_j")) | (F.col("_a.id") < F.col("_b.id")))  # a tile meets itself both ways
    value = iou(lambda c: F.col(f"_a.{c}"), lambda c: F.col(f"_b.{c}"))
    return once.where(value > 0).select(*keys, F.least("_a.id", "_b.id").alias("a"), F.greatest("_a.id", "_b.id").alias("b"), value.alias("iou"))


@query("u_iou", f"WITH {BOXES_SQL}, p AS (SELECT a.frame, a.id AS a, b.id AS b, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i, a.w * a.h + b.w * b.h AS s FROM boxes a JOIN boxes b ON a.frame = b.frame AND a.label = b.label AND a.id < b.id) SELECT frame, a, b, round(i / (s - i), 6) AS iou FROM p WHERE i > 0")
def u_iou(spark, sf_dir):
    rounded = F.floor(F.col("iou") * 1_000_000 + 0.5) / 1_000_000  # as SQL rounds; F.round goes through decimals, one a pair
    return overlaps(boxes(spark, sf_dir), ["frame", "label"]).select("frame", "a", "b", rounded.alias("iou"))


def nms(df: DataFrame, threshold: float) -> DataFrame:
    """Greedy suppression within each frame and label: by falling confidence, a box goes if a kept one overlaps it by more than the threshold. A group is one label's boxes of one frame."""
    box = F.struct((-F.col("conf")).alias("order"), F.col("id"), "conf", "x", "y", "w", "h")
    groups = df.groupBy("frame", "label").agg(F.array_sort(F.collect_list(box)).alias("all"))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, b: F.when(F.exists(acc, lambda k: iou(lambda c: k[c], lambda c: b[c]) > threshold), acc).otherwise(F.concat(acc, F.array(b))))
    return groups.select("frame", "label", F.explode(kept).alias("k")).select("frame", "label", "k.id", "k.conf")


@query(
    "u_nms",
    f"""WITH RECURSIVE {BOXES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY frame, label ORDER BY conf DESC, id) AS n FROM boxes),
    o AS (SELECT a.frame, a.label, a.n AS a, b.n AS b, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i, a.w * a.h + b.w * b.h AS s FROM r a JOIN r b ON a.frame = b.frame AND a.label = b.label AND a.n < b.n),
    hit AS (SELECT frame, label, b, list(a) AS over FROM o WHERE i / (s - i) > 0.45 GROUP BY ALL),
    k(frame, label, n, kept) AS (SELECT frame, label, CAST(1 AS BIGINT), [CAST(1 AS BIGINT)] FROM r WHERE n = 1 UNION ALL
      SELECT k.frame, k.label, k.n + 1, CASE WHEN list_has_any(coalesce(hit.over, []), k.kept) THEN k.kept ELSE list_append(k.kept, k.n + 1) END
      FROM k JOIN r ON r.frame = k.frame AND r.label = k.label AND r.n = k.n + 1 LEFT JOIN hit ON hit.frame = k.frame AND hit.label = k.label AND hit.b = k.n + 1),
    last AS (SELECT frame, label, arg_max(kept, n) AS kept FROM k GROUP BY ALL)
    SELECT r.frame, r.label, r.id, r.conf FROM r JOIN last USING (frame, label) WHERE list_contains(kept, r.n)""",
)
def u_nms(spark, sf_dir):
    return nms(boxes(spark, sf_dir), 0.45)


def decode_anchors(df: DataFrame, classes: int, confidence: float, size: float) -> DataFrame:
    """Rows (frame, anchor, cx, cy, w, h, scores) above the confidence: best class (the first of equals) and corner box over the input size."""
    best = F.array_max("scores")
    out = df.withColumn("conf", best).withColumn("label", (F.array_position("scores", best) - 1).cast("int")).where(F.col("conf") >= confidence)
    corner = lambda c, s: (F.col(c) - F.col(s) / 2) / size
    assert classes > 0
    return out.select("frame", "anchor", "label", "conf", corner("cx", "w").alias("x"), corner("cy", "h").alias("y"), (F.col("w") / size).alias("w"), (F.col("h") / size).alias("h"))


@query("k_detection", "WITH a AS (SELECT p_partkey % 97 AS frame, p_partkey AS anchor, (p_partkey * 7) % 640 * 1.0::DOUBLE AS cx, (p_partkey * 11) % 640 * 1.0::DOUBLE AS cy, 10.0::DOUBLE + p_size AS w, 20.0::DOUBLE AS h, [(p_partkey * 3 % 100) / 100.0::DOUBLE, (p_partkey * 17 % 100) / 100.0::DOUBLE, (p_partkey * 29 % 100) / 100.0::DOUBLE] AS s FROM part) SELECT frame, anchor, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS label, list_max(s) AS conf, round((cx - w / 2) / 640, 9) AS x, round((cy - h / 2) / 640, 9) AS y, round(w / 640, 9) AS w, round(h / 640, 9) AS h FROM a WHERE list_max(s) >= 0.6")
def k_detection(spark, sf_dir):
    k = F.col("p_partkey")
    score = lambda m: (k * m % 100) / 100.0
    a = table(spark, sf_dir, "part").select((k % 97).alias("frame"), k.alias("anchor"), ((k * 7) % 640).cast("double").alias("cx"), ((k * 11) % 640).cast("double").alias("cy"), (10.0 + F.col("p_size")).alias("w"), F.lit(20.0).alias("h"), F.array(score(3), score(17), score(29)).alias("scores"))
    d = decode_anchors(a, 3, 0.6, 640.0)
    return d.withColumns({c: F.round(c, 9) for c in "xywh"})


@query("k_preprocess", "WITH p AS (SELECT p_partkey, (p_partkey * 37) % 220 + 16 AS y, p_size + 100 AS u, p_size + 120 AS v FROM part) SELECT p_partkey, round(((1.164::DOUBLE * (y - 16) + 1.596::DOUBLE * (v - 128)) / 255 - 0.485) / 0.229, 6) AS r, round(((1.164::DOUBLE * (y - 16) + 2.017::DOUBLE * (u - 128)) / 255 - 0.406) / 0.225, 6) AS b FROM p")
def k_preprocess(spark, sf_dir):
    """Limited-range YUV to normalised RGB planes."""
    y, u, v = (F.col("p_partkey") * 37) % 220 + 16, F.col("p_size") + 100, F.col("p_size") + 120
    r, b = 1.164 * (y - 16) + 1.596 * (v - 128), 1.164 * (y - 16) + 2.017 * (u - 128)
    return table(spark, sf_dir, "part").select("p_partkey", F.round((r / 255 - 0.485) / 0.229, 6).alias("r"), F.round((b / 255 - 0.406) / 0.225, 6).alias("b"))


def tensor_batcher(items: DataFrame) -> DataFrame:
    """round, batch and values from items (input, round, values): a round stacks one tensor of every input that still gives any, in the order of inputs.

    An input that has ended drops out, so later batches are smaller. A round waits for nobody here: a table knows where each input ends.
    """
    slots = F.array_sort(F.collect_list(F.struct("input", "values")))  # one for each input at most
    return items.groupBy("round").agg(F.count(F.lit(1)).alias("batch"), slots.alias("_slots")).select("round", "batch", F.flatten(F.transform("_slots", lambda x: x["values"])).alias("values"))


#: Four inputs get 4, 3, 2 and 1 of ten vectors in turn, so they end at different rounds.
_TURNS = (0, 0, 0, 0, 1, 1, 1, 2, 2, 3)
_FIRST, _SHARE = (0, 4, 7, 9), (4, 3, 2, 1)


@query(
    "k_tensor_batcher",
    "WITH t AS (SELECT vec_id, embedding, vec_id % 10 AS k, vec_id // 10 AS ten FROM embeddings), "
    "i AS (SELECT *, CASE WHEN k < 4 THEN 0 WHEN k < 7 THEN 1 WHEN k < 9 THEN 2 ELSE 3 END AS input FROM t), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY input ORDER BY vec_id) - 1 AS round FROM i) "
    "SELECT round, count(*) AS batch, flatten(list(embedding ORDER BY input)) AS values FROM r GROUP BY round",
)
def k_tensor_batcher(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    turn = F.pmod("vec_id", F.lit(10)).cast("int")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at + 1)
    items = e.withColumn("input", pick(_TURNS, turn))
    number = F.expr("vec_id div 10") * pick(_SHARE, F.col("input")) + turn - pick(_FIRST, F.col("input"))
    return tensor_batcher(items.select("input", number.alias("round"), F.col("embedding").alias("values")))
