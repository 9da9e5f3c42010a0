"""Images, signals and networks made from embeddings: 64 values as an image of 8 * 8, a signal or features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..media import audio, images, mapped
from ..neural import evolution, training
from ..neural.modules import mlp
from ..neural.tensor import cross_entropy_loss, mse_loss
from ..operators import lifecycle, sequences
from ..sources import files
from .common import Registry, r6, read, rounded

query = Registry()


def pictures(spark, sf_dir):
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor((F.tanh(x) + 1) * 127.5).cast("double"))
    return read(spark, sf_dir, "embeddings").select("vec_id", v.alias("image"))


def signals(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


IMAGES = "(SELECT vec_id, list_transform(embedding, lambda x: floor((tanh(x::DOUBLE) + 1) * 127.5)) AS image FROM embeddings)"


def total(name: str):
    """vec_id and the sum of the array that a kernel gives, to be held against SQL."""
    return r6(F.aggregate(name, F.lit(0.0), lambda s, x: s + x)).alias("total")


@query("image_flip", f"SELECT vec_id, image[8] AS first, image[57] AS last FROM {IMAGES}")
def image_flip(spark, sf_dir):
    out = mapped(pictures(spark, sf_dir), "image", images.flip, (8, 8))
    return out.select("vec_id", F.element_at("out", 1).alias("first"), F.element_at("out", 64).alias("last"))


@query("image_crop", f"SELECT vec_id, list_sum(list_concat(image[19:22], image[27:30], image[35:38], image[43:46])) AS total FROM {IMAGES}")
def image_crop(spark, sf_dir):
    out = mapped(pictures(spark, sf_dir), "image", lambda x: images.center_crop(x, 4, 4), (8, 8))
    return out.select("vec_id", total("out"))


@query("image_brightness", f"SELECT vec_id, round(list_sum(list_transform(image, lambda v: least(v * 1.5, 255))), 6) AS total FROM {IMAGES}")
def image_brightness(spark, sf_dir):
    out = mapped(pictures(spark, sf_dir), "image", lambda x: images.brightness(x, 1.5), (8, 8))
    return out.select("vec_id", total("out"))


@query("image_standardize", f"WITH m AS (SELECT vec_id, image, list_avg(image) AS m, sqrt(list_avg(list_transform(image, lambda v: v * v)) - pow(list_avg(image), 2)) AS s FROM {IMAGES}) SELECT vec_id, round((image[1] - m) / (s + 1e-10), 6) AS first FROM m")
def image_standardize(spark, sf_dir):
    out = mapped(pictures(spark, sf_dir), "image", images.standardize, (8, 8))
    return out.select("vec_id", r6(F.element_at("out", 1)).alias("first"))


def _kernel(name: str, kernel, shape=(8, 8), source=pictures, col="image", sql: str | None = None):
    """A kernel over every row: with SQL a row (vec_id, i, value) for each number that it gives, else its array."""

    @query(name, sql)
    def run(spark, sf_dir):
        out = mapped(source(spark, sf_dir), col, kernel, shape)
        one = dict(out.dtypes)["out"] == "double"
        if sql is None:
            return out.select("vec_id", r6("out").alias("out") if one else F.transform("out", lambda x: F.round(x, 6)).alias("out"))
        rows = out.select("vec_id", F.posexplode(F.array("out") if one else "out").alias("i", "value"))
        return rows.select("vec_id", F.col("i").cast("long").alias("i"), (r6("value") + 0.0).alias("value"))

    return run


def _m(at: str) -> str:
    """A place on a side of eight, mirrored at the ends."""
    return f"(CASE WHEN {at} < 0 THEN -({at}) - 1 WHEN {at} > 7 THEN 15 - ({at}) ELSE {at} END)"


def _pixels(images: str = IMAGES) -> str:
    return f"(SELECT vec_id, image, i, i // 8 AS y, i % 8 AS x, image[i + 1] AS v FROM {images}, range(64) t(i))"


def _window(reach: int, images: str = IMAGES) -> str:
    return f"(SELECT vec_id, i, y, x, v, dy, dx, image[{_m('y + dy')} * 8 + {_m('x + dx')} + 1] AS q FROM {_pixels(images)}, range(-{reach}, {reach + 1}) a(dy), range(-{reach}, {reach + 1}) b(dx))"


def _value(expression: str, source: str, tail: str = "") -> str:
    return f"SELECT vec_id, i, round({expression}, 6) + 0.0 AS value FROM {source} {tail}"


def _listed(source: str, n: int) -> str:
    """Rows of a list l for every vec_id."""
    return f"SELECT vec_id, i, round(l[i + 1], 6) + 0.0 AS value FROM ({source}), range({n}) t(i)"


def _sampled(sy: str, sx: str, n: int = 64, side: int = 8) -> str:
    """Bilinear values of images at places, 0 outside."""
    places = f"SELECT vec_id, image, i, {sy} AS sy, {sx} AS sx FROM (SELECT *, i // {side} AS y, i % {side} AS x FROM {IMAGES}, range({n}) t(i))"
    corners = f"SELECT *, CAST(greatest(least(floor(sy), 7), 0) AS INT) AS y0, CAST(greatest(least(floor(sx), 7), 0) AS INT) AS x0 FROM ({places})"
    parts = f"SELECT *, least(y0 + 1, 7) AS y1, least(x0 + 1, 7) AS x1, sy - y0 AS fy, sx - x0 AS fx FROM ({corners})"
    mixed = "image[y0 * 8 + x0 + 1] * (1 - fy) * (1 - fx) + image[y1 * 8 + x0 + 1] * fy * (1 - fx) + image[y0 * 8 + x1 + 1] * (1 - fy) * fx + image[y1 * 8 + x1 + 1] * fy * fx"
    return _value(f"CASE WHEN sy >= 0 AND sy <= 7 AND sx >= 0 AND sx <= 7 THEN {mixed} ELSE 0 END", f"({parts})")


def _cross(f: str, images: str) -> str:
    near = ["image[i + 1]", *(f"CASE WHEN {test} THEN image[i + {k}] ELSE 0 END" for test, k in (("y > 0", -7), ("y < 7", 9), ("x > 0", 0), ("x < 7", 2)))]
    return f"(SELECT vec_id, list({f}({', '.join(near)}) ORDER BY i) AS image FROM {_pixels(images)} GROUP BY vec_id)"


def _gradient(side: str, step: int) -> str:
    """Central differences, one-sided at the ends."""
    ahead, behind = f"image[i + 1 + {step}]", f"image[i + 1 - {step}]"
    return f"CASE WHEN {side} = 0 THEN {ahead} - v WHEN {side} = 7 THEN v - {behind} ELSE ({ahead} - {behind}) / 2 END"


BELL = "exp(-(dy * dy + dx * dx) / 2.0)"
BLUR = f"(SELECT vec_id, i, sum(q * {BELL}) / sum({BELL}) AS v FROM {_window(2)} GROUP BY 1, 2)"
ACROSS, DOWN = "sum(q * dx * (2 - abs(dy)))", "sum(q * dy * (2 - abs(dx)))"
BLURRED = f"(SELECT vec_id, list(v ORDER BY i) AS image FROM {BLUR} GROUP BY 1)"
SIZES = f"(SELECT vec_id, i, sqrt(pow({ACROSS}, 2) + pow({DOWN}, 2)) AS s FROM {_window(1, BLURRED)} GROUP BY 1, 2)"
LEVELS = f"(SELECT vec_id, i, y, x, list_transform(image, lambda z: least(floor(z / 32), 7)) AS g FROM {_pixels()})"
LEVEL_PAIRS = f"(SELECT vec_id, g[i + 1] AS a, g[i + 2] AS b FROM {LEVELS} WHERE x < 7 UNION ALL SELECT vec_id, g[i + 1], g[i + 9] FROM {LEVELS} WHERE y < 7)"
GLCM = f"SELECT vec_id, [avg(pow(a - b, 2)), avg(abs(a - b)), avg(1 / (1 + pow(a - b, 2))), any_value(e), (avg(a * b) - avg(a) * avg(b)) / (stddev_pop(a) * stddev_pop(b) + 1e-10)] AS l FROM {LEVEL_PAIRS} JOIN (SELECT vec_id, sqrt(sum(pow(n / 112, 2))) AS e FROM (SELECT vec_id, count(*) AS n FROM {LEVEL_PAIRS} GROUP BY vec_id, a, b) GROUP BY 1) USING (vec_id) GROUP BY 1"
SLOPES = f"(SELECT *, {_gradient('y', 8)} AS gy, {_gradient('x', 1)} AS gx FROM {_pixels()})"
HOG = f"WITH s AS (SELECT vec_id, sqrt(gx * gx + gy * gy) AS s, CAST(least(floor((degrees(atan2(gy, gx)) % 180 + 180) % 180 / 20), 8) AS BIGINT) AS i FROM {SLOPES}) SELECT e.vec_id, t.i, round(coalesce(sum(s), 0), 6) + 0.0 AS value FROM embeddings e CROSS JOIN range(9) t(i) LEFT JOIN s ON s.vec_id = e.vec_id AND s.i = t.i GROUP BY 1, 2"
CENTRES = f"(SELECT vec_id, sum(v) AS t, sum(y * v) / sum(v) AS cy, sum(x * v) / sum(v) AS cx FROM {_pixels()} GROUP BY 1)"
SECOND = f"(SELECT vec_id, any_value(t) AS t, any_value(cy) AS cy, any_value(cx) AS cx, sum(pow(y - cy, 2) * v) / any_value(t) AS yy, sum(pow(x - cx, 2) * v) / any_value(t) AS xx, sum((y - cy) * (x - cx) * v) / any_value(t) AS xy FROM {_pixels()} JOIN {CENTRES} USING (vec_id) GROUP BY 1)"
MOMENTS = f"SELECT vec_id, [t, cy, cx, yy, xx, xy, sqrt(greatest(0, 1 - (yy + xx - d) / (yy + xx + d)))] AS l FROM (SELECT *, sqrt(pow(yy - xx, 2) + 4 * xy * xy) AS d FROM {SECOND})"
AROUND = [(0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)]
LBP = " + ".join(f"CAST(image[i + 1 + {8 * dy + dx}] >= v AS INT) * {2**k}" for k, (dy, dx) in enumerate(AROUND))
FLOW = (
    f"WITH s AS (SELECT vec_id, y, x, gy, gx, image[64 - i] - v AS t FROM {SLOPES}), "
    "w AS (SELECT a.vec_id, a.y, a.x, sum(b.gx * b.gx) AS xx, sum(b.gy * b.gy) AS yy, sum(b.gx * b.gy) AS xy, sum(b.gx * b.t) AS xt, sum(b.gy * b.t) AS yt FROM s a JOIN s b ON b.vec_id = a.vec_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 GROUP BY 1, 2, 3), "
    "f AS (SELECT vec_id, CASE WHEN abs(xx * yy - xy * xy) > 1e-9 THEN -(yy * xt - xy * yt) / (xx * yy - xy * xy) ELSE 0 END AS u, CASE WHEN abs(xx * yy - xy * xy) > 1e-9 THEN -(xx * yt - xy * xt) / (xx * yy - xy * xy) ELSE 0 END AS v FROM w), "
    "z AS (SELECT vec_id, sqrt(u * u + v * v) AS s, atan2(v, u) + CASE WHEN atan2(v, u) < 0 THEN 2 * pi() ELSE 0 END AS a FROM f), "
    "l AS (SELECT vec_id, list_concat([avg(s), stddev_pop(s), max(s)], [" + ", ".join(f"coalesce(sum(s) FILTER (least(floor(a / (2 * pi()) * 8), 7) = {k}), 0) / greatest(sum(s), 1e-10)" for k in range(8)) + "]) AS l FROM z GROUP BY 1) "
) + _listed("FROM l", 11)

for _name, (_f, _sql) in {
    "image_resize": (lambda x: images.resize(x, (4, 4)), _sampled("y * 7 / 3.0", "x * 7 / 3.0", 16, 4)),
    "image_rotate": (lambda x: images.rotate(x, 30.0), _sampled("3.5 + (y - 3.5) * cos(radians(30)) - (x - 3.5) * sin(radians(30))", "3.5 + (y - 3.5) * sin(radians(30)) + (x - 3.5) * cos(radians(30))")),
    "image_zoom": (lambda x: images.zoom(x, 2.0), _sampled("2 + y * 3 / 7.0", "2 + x * 3 / 7.0")),
    "image_noise": (images.gaussian_noise, None),
    "image_elastic": (lambda x: images.elastic(x, 2.0, 1.0), None),
    "image_blur": (images.gaussian_blur, _value("v", BLUR)),
    "image_median": (lambda x: images.median_filter(x, 3), _value("median(q)", _window(1), "GROUP BY 1, 2")),
    "image_bilateral": (lambda x: images.bilateral_filter(x, 3), _value("sum(q * w) / sum(w)", f"(SELECT *, exp(-(dy * dy + dx * dx + pow(q - v, 2)) / 11250.0) AS w FROM {_window(1)})", "GROUP BY 1, 2")),
    "image_sobel": (images.edges, _value(f"least(sqrt(pow({ACROSS}, 2) + pow({DOWN}, 2)), 255)", _window(1), "GROUP BY 1, 2")),
    "image_canny": (images.canny, _value("CASE WHEN s >= 0.3 * m THEN 255 WHEN s >= 0.1 * m THEN 128 ELSE 0 END", f"(SELECT *, max(s) OVER (PARTITION BY vec_id) AS m FROM {SIZES})")),
    "image_opening": (lambda x: images.opening(x > 128), _value("v", _pixels(_cross("greatest", _cross("least", f"(SELECT vec_id, list_transform(image, lambda z: CAST(z > 128 AS INT)) AS image FROM {IMAGES})"))))),
    "image_equalize": (images.equalize, _value("floor(len(list_filter(image, lambda z: z <= v)) / 64.0 * 255)", _pixels())),
    "image_lbp": (images.local_binary_pattern, f"SELECT vec_id, (y - 1) * 6 + x - 1 AS i, round({LBP}, 6) + 0.0 AS value FROM {_pixels()} WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6"),
    "image_glcm": (images.glcm, _listed(GLCM, 5)),
    "image_hog": (images.hog, HOG),
    "image_edge_density": (images.edge_density, _value("avg(CAST(s > 0.1 * m AS INT))", f"(SELECT vec_id, 0::BIGINT AS i, s, max(s) OVER (PARTITION BY vec_id) AS m FROM (SELECT vec_id, i, sqrt(pow({ACROSS}, 2) + pow({DOWN}, 2)) AS s FROM {_window(1)} GROUP BY 1, 2))", "GROUP BY 1, 2")),
    "image_moments": (images.moments, _listed(MOMENTS, 7)),
}.items():
    _kernel(_name, _f, sql=_sql)

SIGNALS = "(SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"


def _power(size: int, hop: int) -> str:
    """Power p of frequency k in frame f of every signal, by a Hann window."""
    term = f"x[f * {hop} + n + 1] * (0.5 - 0.5 * cos(2 * pi() * n / {size}))"
    turns = [f"pow(sum({term} * {g}(2 * pi() * k * n / {size})), 2)" for g in ("cos", "sin")]
    return f"(SELECT vec_id, f, k, {' + '.join(turns)} AS p FROM {SIGNALS}, range({(64 - size) // hop + 1}) a(f), range({size // 2 + 1}) b(k), range({size}) c(n) GROUP BY 1, 2, 3)"


def _read_at(at: str) -> str:
    """The signal at a place between its values, the last one beyond it."""
    low = f"CAST(floor({at}) AS INT)"
    return f"x[{low} + 1] + ({at} - {low}) * (x[least({low} + 2, 64)] - x[{low} + 1])"


MELS = "[700 * (pow(10, log10(1 + 32 / 700.0) * m / 9) - 1) for m in range(10)]"
MEL_LOGS = f"(SELECT vec_id, f, j, ln(sum(p * greatest(0, least((2 * k - c[j + 1]) / (c[j + 2] - c[j + 1]), (c[j + 3] - 2 * k) / (c[j + 3] - c[j + 2])))) + 1e-9) AS g FROM {_power(32, 16)}, range(8) t(j), (SELECT {MELS} AS c) GROUP BY 1, 2, 3)"
COMBS = " + ".join(f"list_sum([pow(0.375, k) * x[CAST(i - k * {d} + 1 AS BIGINT)] for k in range(0, i // {d} + 1)])" for d in (19, 23, 26, 27))

for _name, (_f, _sql) in {
    "audio_spectrogram": (lambda x: audio.decibels(audio.spectrum(x, 32, 16)), f"SELECT vec_id, f * 17 + k AS i, round(10 * log10(greatest(p, 1e-10)), 6) + 0.0 AS value FROM {_power(32, 16)}"),
    "audio_mfcc": (lambda x: audio.mfcc(x, 64, 5, 32, 16, 8), f"SELECT vec_id, f * 5 + c AS i, round(sum(g * cos(pi() * c * (2 * j + 1) / 16)) * CASE WHEN c = 0 THEN sqrt(1 / 8.0) ELSE 0.5 END, 6) + 0.0 AS value FROM {MEL_LOGS}, range(5) u(c) GROUP BY vec_id, f, c"),
    "audio_centroid": (lambda x: audio.centroid(x, 64, 32, 16), f"SELECT vec_id, f AS i, round(sum(p * 2 * k) / (sum(p) + 1e-10), 6) + 0.0 AS value FROM {_power(32, 16)} GROUP BY 1, 2"),
    "audio_rolloff": (lambda x: audio.rolloff(x, 64, 32, 16), f"SELECT vec_id, f AS i, min(2.0 * k) AS value FROM (SELECT *, sum(p) OVER (PARTITION BY vec_id, f ORDER BY k) AS s, sum(p) OVER (PARTITION BY vec_id, f) AS t FROM {_power(32, 16)}) WHERE s >= 0.85 * t GROUP BY 1, 2"),
    "audio_chroma": (lambda x: audio.chroma(x, 2000, 64, 32), f"WITH p AS (SELECT vec_id, p, ((CAST(round(12 * log2(k * 31.25 / 440)) AS BIGINT)) % 12 + 12) % 12 AS c FROM {_power(64, 32)} WHERE k > 0) SELECT e.vec_id, i, round(coalesce(sum(p) FILTER (c = i), 0) / (sum(p) + 1e-10), 6) + 0.0 AS value FROM embeddings e JOIN p USING (vec_id), range(12) t(i) GROUP BY 1, 2"),
    "audio_pitch": (lambda x: audio.pitch(x, 640, 20.0, 200.0), f"SELECT vec_id, 0::BIGINT AS i, round(640.0 / d, 6) AS value FROM (SELECT vec_id, d, sum(x[n + 1] * x[n + d + 1]) AS c FROM {SIGNALS}, range(3, 33) a(d), range(64) b(n) WHERE n + d < 64 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, d) = 1"),
    "audio_stretch": (lambda x: audio.time_stretch(x, 1.25), _value(_read_at("(i * 63 / 50.0)"), f"{SIGNALS}, range(51) t(i)")),
    "audio_reverb": (lambda x: audio.reverb(x, 640), _value(f"x[i + 1] + (({COMBS}) / 4 - x[i + 1]) * 0.5", f"{SIGNALS}, range(64) t(i)")),
    "audio_vibrato": (lambda x: audio.modulated(x, 640), _value(f"CASE WHEN place < 0 THEN 0 ELSE {_read_at('place')} END", f"(SELECT *, i - 0.64 * (1 + sin(10 * pi() * i / 640)) AS place FROM {SIGNALS}, range(64) t(i))")),
}.items():
    _kernel(_name, _f, None, signals, "x", _sql)


@query("audio_echo", "SELECT vec_id, round(list_sum(list_transform(list_zip(x, list_concat(list_transform(range(0, 5), lambda i: 0.0::DOUBLE), x[1:59])), lambda z: abs(z[1] + 0.5 * z[2]))), 6) AS total FROM (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)")
def audio_echo(spark, sf_dir):
    out = signals(spark, sf_dir).select("vec_id", F.transform(sequences.echoed(F.col("x"), 5), F.abs).alias("out"))
    return out.select("vec_id", total("out"))


@query("audio_shift", "SELECT vec_id, round(embedding[62]::DOUBLE, 6) AS first, round(embedding[61]::DOUBLE, 6) AS last FROM embeddings")
def audio_shift(spark, sf_dir):
    y = sequences.shifted(F.col("x"), 3)
    return signals(spark, sf_dir).select("vec_id", r6(F.element_at(y, 1)).alias("first"), r6(F.element_at(y, 64)).alias("last"))


def doubled(spark, sf_dir):
    """Each picture and the same backwards, as two frames."""
    return pictures(spark, sf_dir).select("vec_id", F.concat("image", F.reverse("image")).alias("image"))


_kernel("optical_flow", lambda x: images.flow_statistics(*images.lucas_kanade(x[0], x[1], 3)), (2, 8, 8), doubled, "image", FLOW)


@query("image_grid", "SELECT p_partkey % 16 AS x, round((p_partkey % 16) * 255.0 / 15, 6) AS v FROM part WHERE p_partkey < 17 AND p_partkey > 0")
def image_grid(spark, sf_dir):
    return rounded(files.image_grid(spark, 1, 16, "horizontal").select("x", "v"), "v")


def features(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


@query("mlp_train")
def mlp_train(spark, sf_dir):
    model = mlp([64, 16, 10], seed=1)
    trainer = training.Trainer(model, training.Adam(model.parameters(), 0.01), lambda p, t: cross_entropy_loss(p, t, "sum"))
    trainer.fit(df := features(spark, sf_dir), "label", epochs=5)
    return trainer.predict(df).select("vec_id", F.transform("output", lambda x: F.round(x, 4)).alias("output"))


@query("federated_train")
def federated_train(spark, sf_dir):
    model = mlp([64, 1], seed=2)
    clients = features(spark, sf_dir).select((F.col("vec_id") % 5).alias("client_id"), "v", F.array(F.col("label").cast("double")).alias("y"))
    loss = lambda p, t: mse_loss(p, np.stack(list(t)), "sum")
    updates = training.federated_round(clients, "client_id", "y", model, loss, 0.001, 2)
    return lifecycle.fedavg(updates).withColumn("value", F.round("value", 6))


@query("mc_dropout")
def mc_dropout(spark, sf_dir):
    return rounded(training.mc_dropout(features(spark, sf_dir), "vec_id", mlp([64, 8, 1], dropout=0.2), 5), "mean", "variance")


@query("neat_xor")
def neat_xor(spark, sf_dir):
    best = evolution.Population(2, 1, evolution.Config(population_size=20, seed=3)).evolve(spark, evolution.xor_fitness, 2)
    return spark.createDataFrame([(i, a, b, float(w)) for i, (a, b, w, _) in sorted(best.genes.items())], "innovation int, a int, b int, weight double")


@query("architecture_search")
def architecture_search(spark, sf_dir):
    found = evolution.search(spark, evolution.SearchSpace(), lambda a: -sum(x.size for x in a), 10, batch=5)
    return spark.createDataFrame([(float(s), len(a)) for s, a in found], "score double, layers int")


QUERIES, ORACLE_SQL = query.queries, query.sql
