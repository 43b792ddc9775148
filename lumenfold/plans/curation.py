"""The curation operators as queries over the tables, each beside the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.functions import expr
from lumenfold.operators import bursts, days, duplicates, labels, linkage, manifests, moves, quality, quota, report
from lumenfold.session import cut, table
from lumenfold.settings import QualityLimits
from lumenfold.streaming import intake

DAY = bursts.DAY
_LINKED = [*DAY, "relative_path", "captured_at", "perceptual_hash", "color_histogram"]
_BEST_BY = [*DAY, "relative_path", "captured_at", "blur_score"]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query and, if there is one, its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add


# --- inputs --------------------------------------------------------------------------


def _accepted(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Accepted photos once each, with the named columns; only those are read and shuffled."""
    rows = table(spark, sf, "accepted")
    return bursts.distinct_photos(rows.select("photo_id", *columns) if columns else rows)


def _media(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Files once each, with their class and the named columns."""
    rows = bursts.distinct_photos(table(spark, sf, "media").select("media_id", "source_path", *columns), "media_id")
    ext = expr.extension(F.col("source_path"))
    return rows.withColumns({"extension": ext, "classification": expr.classify(ext)})


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The latest vector of each photo, if it has 128 values."""
    rows = table(spark, sf, "embedding").select("photo_id", F.struct("embedded_at", "vector").alias("r")).groupBy("photo_id").agg(F.max("r").alias("r"))
    return rows.select("photo_id", F.col("r.vector").alias("vector")).where((F.size("vector") == 128) & F.forall("vector", lambda x: F.abs(x) < float("inf")))


def _grids(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector of 64 values as an 8 x 8 grid of pixel values."""
    pixels = F.transform("embedding", lambda v: F.greatest(F.lit(0.0), F.least(F.lit(255.0), (v.cast("double") + 0.5) * 255.0)))
    return table(spark, sf, "embeddings").select("vec_id", "label", pixels.alias("pixels"))


def _bursts(spark: SparkSession, sf: str) -> DataFrame:
    return cut(bursts.burst_groups(_accepted(spark, sf, *_LINKED, "orientation", "blur_score", "brightness_mean", "overexposed_ratio")))


def _clustered(spark: SparkSession, sf: str) -> DataFrame:
    """Photos with burst_id, cluster_id and vector; a burst's representative is the sharpest photo that has a vector."""
    grouped = cut(_bursts(spark, sf).join(_vectors(spark, sf), "photo_id"))
    reps = bursts.burst_representatives(grouped)
    return cut(linkage.day_clusters(grouped, reps, grouped.select("photo_id", "vector"), 0.18))


_PHOTOS = "a AS (SELECT DISTINCT ON (photo_id) * FROM accepted WHERE photo_id IS NOT NULL ORDER BY photo_id)"
_MEDIA = """m AS (SELECT media_id, min(source_path) AS source_path, min(trip_id) AS trip_id, min(modified_at) AS modified_at FROM media GROUP BY media_id),
c AS (SELECT *, lower(regexp_extract(regexp_extract(source_path, '[^/]*$'), '^.+\\.([^.]+)$', 1)) AS ext FROM m),
k AS (SELECT *, CASE WHEN ext IN ('jpg', 'jpeg', 'png', 'heic', 'heif') THEN 'photo' WHEN ext IN ('aae', 'avi', 'json', 'm4v', 'mov', 'mp4', 'txt', 'wav', 'xml') THEN 'non_photo' ELSE 'unsupported' END AS class FROM c)"""
_BURSTS = f"""{_PHOTOS},
e AS (SELECT l.trip_id, l.day_name, l.photo_id AS x, r.photo_id AS y FROM a l JOIN a r ON l.trip_id = r.trip_id AND l.day_name = r.day_name AND l.photo_id < r.photo_id
  AND abs(epoch_us(l.captured_at) - epoch_us(r.captured_at)) <= 120000000
  AND (coalesce(bit_count(xor(l.perceptual_hash, r.perceptual_hash)) <= 6, false) OR coalesce(CASE WHEN len(l.color_histogram) <> len(r.color_histogram) OR coalesce(list_sum(l.color_histogram), 0) = 0 OR coalesce(list_sum(r.color_histogram), 0) = 0 THEN 0 ELSE list_cosine_similarity(l.color_histogram, r.color_histogram) END >= 0.92, false)))"""
_GROUPS = f"""WITH RECURSIVE {_BURSTS},
d AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
walk(node, seen) AS (SELECT x, x FROM d UNION SELECT d.y, w.seen FROM walk w JOIN d ON d.x = w.node),
l AS (SELECT node, min(seen) AS label FROM walk GROUP BY node),
g AS (SELECT a.*, coalesce(l.label, a.photo_id) AS grp FROM a LEFT JOIN l ON l.node = a.photo_id),
h AS (SELECT trip_id, day_name, grp, min({{'n': captured_at IS NULL, 't': captured_at, 'p': relative_path, 'i': photo_id}}) AS f FROM g GROUP BY ALL),
b AS (SELECT trip_id, day_name, grp, row_number() OVER (PARTITION BY trip_id, day_name ORDER BY f.n, f.t NULLS FIRST, f.p, f.i) AS burst_id FROM h),
q AS (SELECT g.*, b.burst_id FROM g JOIN b USING (trip_id, day_name, grp))"""
_PIXELS = "SELECT vec_id, label, list_transform(embedding, lambda v: greatest(0.0, least(255.0, (v::DOUBLE + 0.5) * 255.0))) AS p FROM embeddings"
_BEST = "-coalesce(blur_score, 0), captured_at IS NULL, captured_at, relative_path"


# --- scans, classification, days -----------------------------------------------------


@query(f"WITH {_MEDIA} SELECT media_id, ext AS extension, class AS classification FROM k")
def media_classify(spark, sf):
    """Extension and class of every file."""
    return _media(spark, sf).select("media_id", "extension", "classification")


@query(f"WITH {_MEDIA} SELECT class AS classification, count(*) AS n FROM k GROUP BY class")
def media_counts(spark, sf):
    """Files of each class."""
    return _media(spark, sf).groupBy("classification").agg(F.count("*").alias("n"))


@query(r"""
WITH p AS (SELECT DISTINCT ON (photo_id) photo_id, trim(captured_at) AS t FROM photo ORDER BY photo_id, captured_at), m AS (SELECT media_id, max(modified_at) AS w FROM media GROUP BY media_id),
x AS (SELECT photo_id, CASE WHEN regexp_matches(t, '^\d{4}:\d{1,2}:\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$') THEN try_strptime(t, '%Y:%m:%d %H:%M:%S') END AS e, w AT TIME ZONE 'UTC' AS w FROM p LEFT JOIN m ON m.media_id = p.photo_id)
SELECT photo_id, CASE WHEN e IS NOT NULL THEN 'exif' WHEN w IS NOT NULL THEN 'mtime' END AS resolved_source, epoch_us(coalesce(e, w)) AS resolved_us FROM x
""")
def capture_time_resolve(spark, sf):
    """EXIF time or, without one, that of the file, with its source."""
    photos = table(spark, sf, "photo").groupBy("photo_id").agg(F.min("captured_at").alias("captured_at"))
    got = days.resolve_capture(photos, table(spark, sf, "media"))
    return got.select("photo_id", "resolved_source", F.unix_micros(F.col("resolved_at").cast("timestamp")).alias("resolved_us"))


_DATES = """
p AS (SELECT DISTINCT ON (photo_id) photo_id, trip_id, captured_on FROM photo ORDER BY photo_id, captured_on NULLS LAST),
f AS (SELECT trip_id, (modified_at AT TIME ZONE 'UTC')::DATE AS captured_on FROM k WHERE class <> 'photo' AND modified_at IS NOT NULL),
s AS (SELECT trip_id, captured_on FROM p WHERE captured_on IS NOT NULL UNION SELECT trip_id, captured_on FROM f),
n AS (SELECT trip_id, captured_on, row_number() OVER (PARTITION BY trip_id ORDER BY captured_on) AS day_index FROM s)"""


def _dated(spark, sf):
    photos = table(spark, sf, "photo").groupBy("photo_id").agg(F.min("trip_id").alias("trip_id"), F.min("captured_on").alias("captured_on"))
    other = _media(spark, sf, "trip_id", "modified_at").where("classification <> 'photo'").withColumn("captured_on", F.to_date("modified_at"))
    return photos, other, days.day_map(photos.where("captured_on is not null"), other, by=["trip_id"])


@query(f"WITH {_MEDIA}, {_DATES} SELECT photo_id, day_index::INT AS day_index, printf('day%02d', day_index) AS day_name FROM p JOIN n USING (trip_id, captured_on)")
def day_assignment(spark, sf):
    """The day of each photo with a date."""
    photos, _, numbered = _dated(spark, sf)
    return days.assign_days(photos, numbered, by=["trip_id"]).select("photo_id", "day_index", "day_name")


@query(f"WITH {_MEDIA}, {_DATES} SELECT trip_id, printf('day%02d', day_index) AS day_name, count(photo_id) AS photos FROM n LEFT JOIN p USING (trip_id, captured_on) GROUP BY trip_id, day_index")
def day_counts(spark, sf):
    """Photos of each day, also of days without any."""
    photos, _, numbered = _dated(spark, sf)
    return numbered.join(photos, ["trip_id", "captured_on"], "left").groupBy("trip_id", "day_name").agg(F.count("photo_id").alias("photos"))


@query(f"WITH {_MEDIA}, {_DATES} SELECT trip_id, printf('day%02d', day_index) AS day_name, captured_on::VARCHAR AS captured_on FROM n WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.trip_id = n.trip_id AND p.captured_on = n.captured_on)")
def artifact_only_day(spark, sf):
    """Days that only artifacts have; they take a number too."""
    photos, _, numbered = _dated(spark, sf)
    return numbered.join(photos, ["trip_id", "captured_on"], "left_anti").select("trip_id", "day_name", F.col("captured_on").cast("string").alias("captured_on"))


# --- quality and moves ---------------------------------------------------------------


@query(f"""
WITH {_PHOTOS} SELECT photo_id, array_to_string(list_filter([CASE WHEN blur_score < 30 THEN 'blurry' END, CASE WHEN brightness_mean < 40 THEN 'too_dark' END, CASE WHEN overexposed_ratio > 0.6 THEN 'too_bright' END], lambda v: v IS NOT NULL), ',') AS reasons,
  NOT (coalesce(blur_score < 30, false) OR coalesce(brightness_mean < 40, false) OR coalesce(overexposed_ratio > 0.6, false)) AS is_accepted FROM a
""")
def quality_gate(spark, sf):
    """Reasons against each photo, in their order, and the decision."""
    return quality.assess(_accepted(spark, sf, "blur_score", "brightness_mean", "overexposed_ratio")).select("photo_id", F.array_join("rejection_reasons", ",").alias("reasons"), "is_accepted")


def _plan(spark, sf):
    photos = quality.assess(_accepted(spark, sf, "trip_id", "day_name", "source_path", "blur_score", "brightness_mean", "overexposed_ratio"))
    dated = _dated(spark, sf)
    other = days.assign_days(dated[1], dated[2], by=["trip_id"])
    keep = lambda plan, src: plan.join(src.select("source_path", "trip_id"), "source_path")
    return moves.move_plan(keep(moves.photo_plan(photos), photos), keep(moves.artifact_plan(other), other))


_PLAN = f"""{_PHOTOS}, {_MEDIA}, {_DATES},
z AS (SELECT trip_id, source_path, day_name, CASE WHEN blur_score < 30 OR brightness_mean < 40 OR overexposed_ratio > 0.6 THEN 'rejected' ELSE 'accepted' END AS cat, regexp_extract(source_path, '[^/]*$') AS file FROM a
  UNION ALL SELECT k.trip_id, source_path, printf('day%02d', day_index), 'not_photo', regexp_extract(source_path, '[^/]*$') FROM k JOIN n ON n.trip_id = k.trip_id AND n.captured_on = (k.modified_at AT TIME ZONE 'UTC')::DATE WHERE class <> 'photo'),
t AS (SELECT *, CASE cat WHEN 'accepted' THEN day_name || '/' || file WHEN 'rejected' THEN day_name || '/_rejected/low_quality/' || file ELSE day_name || '/_rejected/not_photo/' || file END AS target FROM z)"""


@query(f"WITH {_PLAN} SELECT source_path, cat AS destination_category, target FROM t")
def move_plan(spark, sf):
    """Where each file goes."""
    return _plan(spark, sf).select("source_path", "destination_category", "target")


@query(f"WITH {_PLAN} SELECT cat AS destination_category, count(*) AS n, count(DISTINCT {{'t': trip_id, 'd': day_name}}) AS days FROM t GROUP BY cat")
def quality_routes(spark, sf):
    """Files of each destination and the days they go to."""
    return _plan(spark, sf).groupBy("destination_category").agg(F.count("*").alias("n"), F.count_distinct("trip_id", "day_name").alias("days"))


@query(f"""
WITH {_PHOTOS}, o AS (SELECT photo_id, day_name || '/' || upper(regexp_extract(relative_path, '^[^/]*/(.)', 1)) AS base, CASE WHEN photo_id % 7 = 0 THEN 1 ELSE 0 END AS k, lower(regexp_extract(source_path, '[^/]*$')) AS l, source_path, trip_id FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY trip_id, base, k ORDER BY l, source_path) = 1 AS stays FROM o), t AS (SELECT trip_id, base, list(DISTINCT k) AS taken FROM o GROUP BY ALL),
n AS (SELECT r.*, taken, row_number() OVER (PARTITION BY r.trip_id, r.base, stays ORDER BY l, source_path) AS turn FROM r JOIN t ON t.trip_id IS NOT DISTINCT FROM r.trip_id AND t.base IS NOT DISTINCT FROM r.base)
SELECT photo_id, base || CASE WHEN stays THEN CASE WHEN k = 1 THEN '__dup01' ELSE '' END ELSE printf('__dup%02d', list_filter(range(1, turn + len(taken) + 1), lambda i: NOT list_contains(taken, i))[turn]) END || '.jpg' AS final_target FROM n
""")
def move_collisions(spark, sf):
    """Names of files that want one target, some of them numbered before: no two end at the same."""
    mark = F.when(F.col("photo_id") % 7 == 0, "__dup01").otherwise("")
    plan = _accepted(spark, sf, "trip_id", "day_name", "source_path", "relative_path").select("photo_id", "trip_id", "source_path", F.concat("day_name", F.lit("/"), F.upper(F.regexp_extract("relative_path", "^[^/]*/(.)", 1)), mark, F.lit(".jpg")).alias("target"))
    return moves.resolve_collisions(plan, by=["trip_id"]).select("photo_id", "final_target")


@query(f"WITH {_PHOTOS} SELECT CASE WHEN width > height THEN 'landscape' WHEN height > width THEN 'portrait' WHEN width = height THEN 'square' END AS shape, count(*) AS n FROM a GROUP BY 1")
def orientation_counts(spark, sf):
    """Photos of each orientation, from their sides."""
    return _accepted(spark, sf, "width", "height").groupBy(expr.orientation(F.col("width"), F.col("height")).alias("shape")).agg(F.count("*").alias("n"))


# --- pixel features on grids ---------------------------------------------------------


@query(f"""
WITH g AS ({_PIXELS}), i AS (SELECT vec_id, p, list_transform(range(0, 36), lambda k: p[(k // 6) * 8 + (k % 6) + 2] + p[(k // 6 + 2) * 8 + (k % 6) + 2] + p[(k // 6 + 1) * 8 + (k % 6) + 1] + p[(k // 6 + 1) * 8 + (k % 6) + 3] - 4 * p[(k // 6 + 1) * 8 + (k % 6) + 2]) AS l FROM g)
SELECT vec_id, round(list_var_pop(l), 4) AS laplacian_variance, round(list_avg(p), 4) AS brightness_mean, round(len(list_filter(p, lambda v: v >= 150)) / len(p), 4) AS overexposed_ratio FROM i
""")
def quality_metrics_grid(spark, sf):
    """Sharpness, brightness and share of bright pixels of each grid."""
    got = quality.grid_metrics(_grids(spark, sf), "pixels", 8, 8, QualityLimits(bright_pixel=150))
    return got.select("vec_id", *[F.round(c, 4).alias(c) for c in ("laplacian_variance", "brightness_mean", "overexposed_ratio")])


@query(f"""
WITH g AS ({_PIXELS}), t AS (SELECT vec_id, q, p, (q // 2) * 32 + (q % 2) * 4 AS o FROM g, range(0, 4) AS r(q)),
v AS (SELECT vec_id, q, list_var_pop(list_transform([o + 9, o + 10, o + 17, o + 18], lambda c: p[c + 1 - 8] + p[c + 1 + 8] + p[c] + p[c + 2] - 4 * p[c + 1])) AS s FROM t)
SELECT vec_id, round(max(s), 4) AS blur_score FROM v GROUP BY vec_id
""")
def tile_blur_grid(spark, sf):
    """Mean sharpness of the sharpest quarter of 2 x 2 tiles."""
    return _grids(spark, sf).select("vec_id", F.round(quality.tile_blur(F.col("pixels"), 8, 8, QualityLimits(tile_rows=2, tile_cols=2)), 4).alias("blur_score"))


@query(f"WITH g AS ({_PIXELS}) SELECT vec_id, list_reduce(list_prepend(0::BIGINT, list_transform(range(0, 56), lambda k: (p[(k // 7) * 8 + (k % 7) + 2] > p[(k // 7) * 8 + (k % 7) + 1])::BIGINT)), lambda s, b: s * 2 + b) AS hash FROM g")
def dhash_grid(spark, sf):
    """Difference hash of each grid."""
    return _grids(spark, sf).select("vec_id", expr.difference_hash(F.col("pixels"), 8, 8).alias("hash"))


@query(f"WITH g AS ({_PIXELS}) SELECT vec_id, array_to_string(list_transform(range(0, 8), lambda b: len(list_filter(p, lambda v: floor(v * 8 / 256) = b))), ',') AS bins FROM g")
def histogram_grid(spark, sf):
    """Pixels of each grid in eight bins."""
    shares = expr.histogram(F.col("pixels"))
    return _grids(spark, sf).select("vec_id", F.array_join(F.transform(shares, lambda s: F.round(s * 64).cast("int").cast("string")), ",").alias("bins"))


@query(f"WITH {_PHOTOS} SELECT l.photo_id AS x, r.photo_id AS y, bit_count(xor(l.perceptual_hash, r.perceptual_hash))::INT AS bits FROM a l JOIN a r ON l.trip_id = r.trip_id AND l.day_name = r.day_name AND l.photo_id < r.photo_id WHERE bit_count(xor(l.perceptual_hash, r.perceptual_hash)) <= 6")
def hamming_pairs(spark, sf):
    """Photos of one day whose hashes differ in at most six bits."""
    rows = _accepted(spark, sf, *DAY, "perceptual_hash").select(*DAY, "photo_id", "perceptual_hash")
    left, right = rows.withColumnsRenamed({"photo_id": "x", "perceptual_hash": "h"}), rows.withColumnsRenamed({"photo_id": "y", "perceptual_hash": "k"})
    return left.join(right, DAY).where("x < y").withColumn("bits", expr.hamming(F.col("h"), F.col("k"))).where("bits <= 6").select("x", "y", "bits")


@query("SELECT l.vec_id AS x, r.vec_id AS y, round(list_cosine_similarity(l.embedding::DOUBLE[], r.embedding::DOUBLE[]), 4) AS cosine FROM embeddings l JOIN embeddings r ON l.label = r.label AND l.vec_id < r.vec_id WHERE list_cosine_similarity(l.embedding::DOUBLE[], r.embedding::DOUBLE[]) >= 0.3")
def cosine_pairs(spark, sf):
    """Vectors of one label with a cosine of at least 0.3."""
    rows = table(spark, sf, "embeddings")
    left, right = rows.select("label", F.col("vec_id").alias("x"), F.col("embedding").alias("u")), rows.select("label", F.col("vec_id").alias("y"), F.col("embedding").alias("v"))
    return left.join(right, "label").where("x < y").withColumn("cosine", expr.cosine(F.col("u"), F.col("v"))).where("cosine >= 0.3").select("x", "y", F.round("cosine", 4).alias("cosine"))


# --- bursts --------------------------------------------------------------------------


@query(f"WITH {_BURSTS} SELECT x, y FROM e")
def burst_edges(spark, sf):
    """Links between photos of one day that are close in time and look alike."""
    return bursts.burst_edges(_accepted(spark, sf, *_LINKED)).select("x", "y")


@query(f"{_GROUPS} SELECT photo_id, trip_id, day_name, burst_id::INT AS burst_id FROM q")
def burst_groups(spark, sf):
    """The burst of each photo."""
    return bursts.burst_groups(_accepted(spark, sf, *_LINKED)).select("photo_id", *DAY, "burst_id")


@query(f"{_GROUPS}, r AS (SELECT *, row_number() OVER (PARTITION BY trip_id, day_name, burst_id ORDER BY {_BEST}) AS i, count(*) OVER (PARTITION BY trip_id, day_name, burst_id) AS member_count FROM q) SELECT trip_id, day_name, burst_id::INT AS burst_id, photo_id AS representative_id, member_count FROM r WHERE i = 1")
def burst_representatives(spark, sf):
    """The photo that stands for each burst."""
    return bursts.burst_representatives(bursts.burst_groups(_accepted(spark, sf, *_LINKED, "blur_score"))).drop("representative_path")


@query(f"{_GROUPS} SELECT photo_id, printf('c%03d_b%03d_%03d', 1, burst_id, row_number() OVER (PARTITION BY trip_id, day_name, burst_id ORDER BY captured_at IS NULL, captured_at, relative_path)) || regexp_extract(relative_path, '(\\.[^.]+)$', 1) AS new_name FROM q")
def survivor_names(spark, sf):
    """The new name of each photo, numbered in its burst."""
    return duplicates.survivor_names(bursts.burst_groups(_accepted(spark, sf, *_LINKED)).withColumn("cluster_id", F.lit(1))).select("photo_id", "new_name")


# --- linkage -------------------------------------------------------------------------


@query()
def agglomerative_clusters(spark, sf):
    """The cluster of each burst, by average linkage of their representatives."""
    grouped = cut(_bursts(spark, sf).join(_vectors(spark, sf), "photo_id"))
    reps = bursts.burst_representatives(grouped).join(grouped.select(F.col("photo_id").alias("representative_id"), "vector"), "representative_id")
    return linkage.cluster_representatives(reps, 0.18)


@query()
def day_clusters(spark, sf):
    """The cluster and burst of each photo."""
    return _clustered(spark, sf).select("photo_id", *DAY, "burst_id", "cluster_id")


@query("""
WITH p AS (SELECT l.label, l.vec_id, round(avg(1 - list_cosine_similarity(l.embedding::DOUBLE[], r.embedding::DOUBLE[])), 9) AS mean, count(*) AS member_count FROM embeddings l JOIN embeddings r ON l.label = r.label GROUP BY l.label, l.vec_id)
SELECT label, vec_id AS medoid, round(mean, 6) AS mean_distance, member_count FROM p QUALIFY row_number() OVER (PARTITION BY label ORDER BY mean, vec_id) = 1
""")
def cluster_medoids(spark, sf):
    """The vector of least mean distance to all of its label."""
    return linkage.medoids(table(spark, sf, "embeddings"), ["label"], "vec_id", "embedding").withColumn("mean_distance", F.round("mean_distance", 6))


@query(f"""
{_GROUPS}, r AS (SELECT *, row_number() OVER (PARTITION BY trip_id, day_name, burst_id ORDER BY {_BEST}) AS i FROM q), f AS (SELECT trip_id, day_name, burst_id, perceptual_hash AS h, color_histogram AS c FROM r WHERE i = 1)
SELECT photo_id, round(CASE WHEN color_histogram IS NULL OR c IS NULL OR len(color_histogram) <> len(c) THEN NULL WHEN coalesce(list_sum(color_histogram), 0) = 0 OR coalesce(list_sum(c), 0) = 0 THEN 0 ELSE list_cosine_similarity(color_histogram, c) END, 6) AS histogram_similarity, bit_count(xor(perceptual_hash, h))::INT AS hash_distance FROM q JOIN f USING (trip_id, day_name, burst_id)
""")
def cluster_member_metrics(spark, sf):
    """Each photo's distances to the representative of its burst."""
    grouped = cut(bursts.burst_groups(_accepted(spark, sf, *_LINKED, "blur_score"))).withColumn("vector", F.lit(None).cast("array<float>"))
    got = linkage.member_metrics(grouped, bursts.burst_representatives(grouped), [*DAY, "burst_id"])
    return got.select("photo_id", F.round("histogram_similarity_to_representative", 6).alias("histogram_similarity"), F.col("perceptual_hash_distance_to_representative").alias("hash_distance"))


# --- duplicates ----------------------------------------------------------------------


@query(f"WITH g AS ({_PIXELS}), s AS (SELECT l.label, l.vec_id AS x, r.vec_id AS y, 1 - list_avg(list_transform(list_zip(l.p, r.p), lambda z: abs(z[1] - z[2]))) / 255.0 AS s FROM g l JOIN g r ON l.label = r.label AND l.vec_id < r.vec_id) SELECT label, x, y, round(s, 5) AS similarity FROM s WHERE s >= 0.88")
def duplicate_pairs_grid(spark, sf):
    """Grids of one label whose pixels differ little."""
    got = duplicates.duplicate_pairs(_grids(spark, sf), "pixels", 0.88, ["label"], "vec_id")
    return got.withColumn("similarity", F.round("similarity", 5))


def _hash_sets(spark, sf):
    """Photos of one day with one hash, as duplicate sets."""
    rows = _accepted(spark, sf, *_BEST_BY, "perceptual_hash").where("perceptual_hash is not null")
    first = rows.groupBy(*DAY, "perceptual_hash").agg(F.min("photo_id").alias("set_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(first, [*DAY, "perceptual_hash"])


_SETS_SQL = f"""{_PHOTOS}, s AS (SELECT *, min(photo_id) OVER w AS set_id, count(*) OVER w AS n FROM a WHERE perceptual_hash IS NOT NULL WINDOW w AS (PARTITION BY trip_id, day_name, perceptual_hash)),
r AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY {_BEST}) AS place FROM s WHERE n > 1)"""


@query(f"WITH {_SETS_SQL} SELECT photo_id, set_id FROM r")
def duplicate_sets(spark, sf):
    """Photos of one day with one hash."""
    rows = _accepted(spark, sf, *DAY, "perceptual_hash").where("perceptual_hash is not null")
    star = rows.groupBy(*DAY, "perceptual_hash").agg(F.min("photo_id").alias("x"))
    edges = rows.join(star, [*DAY, "perceptual_hash"]).where("x < photo_id").select(*DAY, "x", F.col("photo_id").alias("y"))
    return duplicates.duplicate_sets(rows, edges, DAY).select("photo_id", "set_id")


@query(f"WITH {_SETS_SQL} SELECT set_id, photo_id FROM r WHERE place = 1")
def duplicate_winners(spark, sf):
    """The photo of each set that stays."""
    return duplicates.winners(_hash_sets(spark, sf), []).select("set_id", "photo_id")


@query(f"WITH {_SETS_SQL} SELECT set_id, photo_id FROM r WHERE place > 1")
def duplicate_losers(spark, sf):
    """The photos of each set that go."""
    return duplicates.losers(_hash_sets(spark, sf), []).select("set_id", "photo_id")


@query(f"WITH {_SETS_SQL} SELECT a.trip_id, a.day_name, count(*) AS photos FROM a WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.photo_id = a.photo_id AND place > 1) GROUP BY ALL")
def survivors(spark, sf):
    """Photos of each day that stay."""
    return duplicates.survivors(_accepted(spark, sf, *DAY), duplicates.losers(_hash_sets(spark, sf), [])).groupBy(*DAY).agg(F.count("*").alias("photos"))


@query(f"WITH {_PHOTOS}, o AS (SELECT trip_id, day_name || '/' || orientation || regexp_extract(relative_path, '(\\.[^.]+)$', 1) AS target FROM a) SELECT trip_id, target, count(*) AS n FROM o GROUP BY ALL HAVING count(*) > 1")
def rename_conflicts(spark, sf):
    """Targets that several renames share."""
    renames = _accepted(spark, sf, "trip_id", "day_name", "relative_path", "orientation").select("trip_id", F.col("relative_path").alias("source_path"), F.concat("day_name", F.lit("/"), "orientation", expr.suffix(F.col("relative_path"))).alias("target"))
    return moves.rename_conflicts(renames, by=["trip_id"]).drop("taken")


@query(f"""
{_GROUPS}, r AS (SELECT *, row_number() OVER (PARTITION BY trip_id, day_name, burst_id ORDER BY {_BEST}) AS i FROM q)
SELECT trip_id, day_name, burst_id::INT AS burst_id, photo_id AS representative FROM r WHERE i > 1 QUALIFY row_number() OVER (PARTITION BY trip_id, day_name, burst_id ORDER BY {_BEST}) = 1
""")
def representative_fallback(spark, sf):
    """Who stands for a burst when its representative is lost."""
    grouped = cut(bursts.burst_groups(_accepted(spark, sf, *_LINKED, "blur_score")))
    reps = bursts.burst_representatives(grouped)
    by = [*DAY, "burst_id"]
    alive = grouped.join(reps.select(F.col("representative_id").alias("photo_id")), "photo_id", "left_anti")
    return duplicates.fallback_representatives(alive, reps.select(*by, F.col("representative_id").alias("original")), by)


# --- manifests, labels, summaries ----------------------------------------------------


def _manifest(spark, sf):
    members = _bursts(spark, sf).withColumn("cluster_id", F.col("burst_id"))
    reps = bursts.burst_representatives(members)
    return members, reps, manifests.build(members, reps.select(*DAY, F.col("burst_id").alias("cluster_id"), "representative_path"), reps)


@query(f"{_GROUPS}, s AS (SELECT trip_id, day_name, burst_id, count(*) AS n FROM q GROUP BY ALL) SELECT trip_id, day_name, sum(n)::BIGINT AS photos, count(*) AS bursts, count(*) AS clusters, count(*) FILTER (WHERE n = 1) AS alone FROM s GROUP BY ALL")
def manifest_summary(spark, sf):
    """The counts in each day's manifest."""
    s = F.col("summary")
    return _manifest(spark, sf)[2].select(*DAY, s["accepted_photo_count"].alias("photos"), s["burst_group_count"].alias("bursts"), s["cluster_count"].alias("clusters"), s["singleton_cluster_count"].alias("alone"))


@query(f"{_GROUPS} SELECT trip_id, day_name, printf('cluster%03d', burst_id) AS cluster_id, printf('burst%03d', burst_id) AS burst_group_id, regexp_extract(relative_path, '[^/]*$') AS filename, orientation FROM q")
def manifest_members(spark, sf):
    """The members in the manifests, taken out of the nested documents again."""
    flat = _manifest(spark, sf)[2].select(*DAY, F.explode("clusters").alias("c")).select(*DAY, F.col("c.cluster_id").alias("cluster_id"), F.explode("c.members").alias("m"))
    return flat.select(*DAY, "cluster_id", "m.burst_group_id", "m.filename", "m.orientation")


@query()
def manifest_documents(spark, sf):
    """The JSON document of each day, with clusters by linkage and the distances of their members."""
    members = _clustered(spark, sf)
    by = [*DAY, "cluster_id"]
    chosen = linkage.medoids(members, by).withColumnRenamed("medoid", "representative_path")
    reps = members.join(chosen.select(*by, F.col("representative_path").alias("relative_path")), [*by, "relative_path"]).select(*by, F.col("photo_id").alias("representative_id"))
    built = manifests.build(linkage.member_metrics(members, reps, by), chosen, bursts.burst_representatives(members))
    return manifests.documents(built).select(*DAY, "payload")


@query()
def manifest_after_cleanup(spark, sf):
    """Each day's summary after duplicates are gone and survivors renamed."""
    members, reps, _ = _manifest(spark, sf)
    alive = duplicates.survivor_names(duplicates.survivors(members, duplicates.losers(_hash_sets(spark, sf), [])))
    again = manifests.after_cleanup(members, alive, reps.select(*DAY, F.col("burst_id").alias("cluster_id"), "representative_path"))
    s = F.col("summary")
    return again.select(*DAY, s["accepted_photo_count"].alias("photos"), s["burst_group_count"].alias("bursts"), s["cluster_count"].alias("clusters"), s["singleton_cluster_count"].alias("alone"))


def _labelled(spark, sf):
    members, reps, built = _manifest(spark, sf)
    chosen = labels.candidates(members, reps, DAY)
    return members, cut(labels.categorize(chosen, labels.RuleCategorizer(), DAY)), built


_LABELS = "['people', 'animals', 'food', 'nature', 'city', 'architecture', 'other'][(2 * burst_id) % 7 + 1]"


@query(f"{_GROUPS} SELECT trip_id, day_name, burst_id::INT AS burst_id, photo_id FROM q QUALIFY row_number() OVER (PARTITION BY trip_id, day_name, burst_id ORDER BY {_BEST}) = 1")
def burst_label_candidates(spark, sf):
    """The photo by which each burst is labelled."""
    members, reps, _ = _manifest(spark, sf)
    return labels.candidates(members, reps, DAY).select(*DAY, "burst_id", "photo_id")


@query(f"{_GROUPS} SELECT DISTINCT trip_id, day_name, burst_id::INT AS burst_id, {_LABELS} AS category_name FROM q")
def category_assign(spark, sf):
    """The label of each burst by the deterministic plug-in."""
    return _labelled(spark, sf)[1].select(*DAY, "burst_id", "category_name")


@query(f"{_GROUPS} SELECT trip_id, day_name, {_LABELS} AS category_name, count(*) AS n FROM q GROUP BY ALL")
def category_counts(spark, sf):
    """Members of each label in the rewritten manifests."""
    _, results, built = _labelled(spark, sf)
    return manifests.with_categories(built, results).select(*DAY, F.explode("summary.category_counts").alias("category_name", "n"))


@query(f"{_GROUPS} SELECT photo_id, relative_path AS source_path, day_name || '/' || {_LABELS} || '/' || regexp_extract(relative_path, '[^/]*$') AS target FROM q")
def category_moves(spark, sf):
    """Where each labelled photo goes."""
    members, results, _ = _labelled(spark, sf)
    return labels.category_moves(members, results, DAY).select("photo_id", "source_path", "target")


@query(f"""
WITH {_PHOTOS}, {_MEDIA}, u AS (SELECT count(*) AS total_items, count(*) FILTER (WHERE class = 'photo') AS photo_items, count(*) FILTER (WHERE class = 'non_photo') AS non_photo_items, count(*) FILTER (WHERE class = 'unsupported') AS unsupported_items FROM k),
v AS (SELECT count(*) FILTER (WHERE coalesce(blur_score < 30, false) OR coalesce(brightness_mean < 40, false) OR coalesce(overexposed_ratio > 0.6, false)) AS rejected_photos, count(*) AS n, count(DISTINCT {{'t': trip_id, 'd': day_name}}) AS day_count FROM a),
w AS (SELECT unnest(['total_items', 'photo_items', 'non_photo_items', 'unsupported_items', 'accepted_photos', 'rejected_photos', 'day_count']) AS counter, unnest([total_items, photo_items, non_photo_items, unsupported_items, n - rejected_photos, rejected_photos, day_count]) AS value FROM u, v)
SELECT counter, value FROM w
""")
def run_summary(spark, sf):
    """The counters of the first stages as rows."""
    assessed = quality.assess(_accepted(spark, sf, *DAY, "blur_score", "brightness_mean", "overexposed_ratio"))
    parts = [report.file_counts(_media(spark, sf)), report.quality_counts(assessed), assessed.agg(F.count_distinct(*DAY).alias("day_count"))]
    shown = ["total_items", "photo_items", "non_photo_items", "unsupported_items", "accepted_photos", "rejected_photos", "day_count"]
    return report.as_rows(report.summary(parts)).where(F.col("counter").isin(shown)).select("counter", "value")


@query(f"""
WITH RECURSIVE {_PHOTOS}, o AS (SELECT trip_id, day_name, count(*) AS n FROM a GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY day_name) AS d FROM o),
w(trip_id, d, upto, take) AS (SELECT trip_id, 1, least(n, 10, 60)::BIGINT, least(n, 10, 60)::BIGINT FROM n WHERE d = 1 UNION ALL SELECT n.trip_id, n.d, least(w.upto + n.n, 10 * n.d, 60)::BIGINT, (least(w.upto + n.n, 10 * n.d, 60) - w.upto)::BIGINT FROM w JOIN n ON n.trip_id = w.trip_id AND n.d = w.d + 1),
r AS (SELECT *, row_number() OVER (PARTITION BY trip_id, day_name ORDER BY {_BEST}) AS place FROM a)
SELECT r.trip_id, r.day_name, r.photo_id, place::INT AS place FROM r JOIN n USING (trip_id, day_name) JOIN w ON w.trip_id = n.trip_id AND w.d = n.d WHERE place <= take
""")
def quota_selection(spark, sf):
    """The album of each trip: ten photos a day, sixty in total, with roll-over."""
    return quota.select_album(_accepted(spark, sf, *_BEST_BY), 10, 60, ["trip_id"], "day_name", [bursts.best_first()]).select(*DAY, "photo_id", "place")


@query(f"{_GROUPS} SELECT count(DISTINCT {{'t': trip_id, 'd': day_name, 'b': burst_id}}) AS classified_clusters FROM q")
def classified_clusters(spark, sf):
    """How many clusters have a labelled burst."""
    return labels.classified_clusters(_labelled(spark, sf)[1], DAY)


@query(f"WITH {_MEDIA} SELECT media_id, row_number() OVER (PARTITION BY trip_id ORDER BY lower(regexp_extract(source_path, '[^/]*$')), source_path)::INT AS place FROM k")
def scan_order(spark, sf):
    """The place of each file in the listing of its trip."""
    order = Window.partitionBy("trip_id").orderBy(F.lower(expr.file_name(F.col("source_path"))), "source_path")
    return _media(spark, sf, "trip_id").select("media_id", F.row_number().over(order).alias("place"))


@query("""
SELECT strftime(date_trunc('day', ingested_at AT TIME ZONE 'UTC'), '%Y-%m-%d') AS day, CASE WHEN e IN ('jpg', 'jpeg', 'png', 'heic', 'heif') THEN 'photo' WHEN e IN ('aae', 'avi', 'json', 'm4v', 'mov', 'mp4', 'txt', 'wav', 'xml') THEN 'non_photo' ELSE 'unsupported' END AS classification, count(*) AS n, sum(size_bytes)::BIGINT AS bytes
FROM (SELECT *, lower(regexp_extract(regexp_extract(source_path, '[^/]*$'), '^.+\\.([^.]+)$', 1)) AS e FROM media WHERE ingested_at IS NOT NULL) GROUP BY 1, 2
""")
def intake_windows(spark, sf):
    """Arrivals of each day and class: the batch form of the stream's windows."""
    got = intake.window_counts(intake.classified(table(spark, sf, "media")))
    return got.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "classification", "n", "bytes")


@query(f"WITH {_PHOTOS}, m AS (SELECT media_id, min(modified_at) AS w FROM media GROUP BY media_id) SELECT trip_id, count(*) AS photos, count(w) AS with_file, sum(CASE WHEN w IS NULL THEN 1 ELSE 0 END)::BIGINT AS without_file FROM a LEFT JOIN m ON m.media_id = a.photo_id GROUP BY trip_id")
def record_enrichment(spark, sf):
    """Accepted photos of each trip with and without the time of a file."""
    files = table(spark, sf, "media").groupBy("media_id").agg(F.min("modified_at").alias("w"))
    joined = _accepted(spark, sf, "trip_id").join(files, F.col("photo_id") == F.col("media_id"), "left")
    return joined.groupBy("trip_id").agg(F.count("*").alias("photos"), F.count("w").alias("with_file"), F.count_if(F.col("w").isNull()).alias("without_file"))
