"""Distributed modelling: multi-label ridge over labelled documents, one-class ridge over ``embeddings``.

The multi-label table: every document of ``labels``, its language, ``quality`` and ``toxic`` as labels, and
shares of character patterns as features.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import metrics, models, multilabel, splits
from ..session import cut_lineage, scratch_path
from ..sources import table
from .registry import query

N_LABELS = 10
ALPHAS = [0.01, 0.1, 1.0, 10.0, 100.0]


def emb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


@query("pca_2d")
def pca_2d(spark, sf_dir):
    """M9 + M1: centred 2-component PCA of the embeddings (signs are arbitrary)."""
    return models.pca_2d(emb(spark, sf_dir), "embedding", "vec_id")


@query("ridge_argmax")
def ridge_argmax(spark, sf_dir):
    """M1–M4 + M8: standardise → variance filter → one ±1 ridge regression per
    label from one pass of summable statistics; predict = argmax; the fitted
    coefficients are saved as a parquet table under the shared checkpoint folder."""
    e = emb(spark, sf_dir)
    pipe = models.RidgePipeline("embedding", "label", N_LABELS, alpha=1.0).fit(e)
    models.save_model(spark, pipe.model, scratch_path(spark, "ridge-model"))
    out = pipe.transform(e)
    return out.select("vec_id", "label", "pred", (F.col("pred") == F.col("label")).alias("correct"))


SCORE_SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("fold", T.LongType()),
                             T.StructField("alpha", T.DoubleType()), T.StructField("label", T.IntegerType()),
                             T.StructField("pred", T.IntegerType())])


@query("ridge_grid_cv")
def ridge_grid_cv(spark, sf_dir):
    """M5 + M6 + M7 + A22 + A23: grid search over alpha with 5 stratified folds.

    One statistics pass grouped by fold; the training statistics of fold f
    are total − fold f, so all (alpha, fold) models come from that pass.  Test
    rows are scored in Arrow batches against the (bounded) set of models,
    macro-F1 comes from the confusion algebra, the mean over folds ranks the
    alphas and the best alpha is refit on all rows (fold = -1 summary row)."""
    e = emb(spark, sf_dir)
    f = splits.stratified_folds(e.select("vec_id", F.col("label").alias("stratum")), "vec_id", k=5, reps=1)
    x = e.join(f.select("vec_id", "fold"), "vec_id")
    st = models.ridge_stats(x, "embedding", "label", N_LABELS, group="fold")
    total = models.combine(list(st.values()))
    params = {}
    for fold, s in st.items():
        train = models.combine([total, s], [1.0, -1.0])
        for a in ALPHAS:
            m = models.ridge_solve(train, a)
            params[(fold, a)] = (m["coef"], m["intercept"])

    def score(batches):
        for pdf in batches:
            for fold, part in pdf.groupby("fold"):
                xm = np.stack(part["embedding"].to_numpy()).astype(np.float64)
                for a in ALPHAS:
                    coef, b = params[(int(fold), a)]
                    pred = np.argmax(xm @ coef + b, axis=1)
                    yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "fold": int(fold), "alpha": a,
                                        "label": part["label"].to_numpy().astype("int32"),
                                        "pred": pred.astype("int32")})

    sc = x.select("vec_id", "fold", "embedding", "label").mapInPandas(score, SCORE_SCHEMA)
    truth = sc.select("vec_id", "fold", "alpha", F.col("label").cast("string").alias("label"))
    pred = sc.select("vec_id", "fold", "alpha", F.col("pred").cast("string").alias("label"))
    conf = metrics.confusion(truth, pred, ["vec_id", "fold", "alpha"]).filter(F.col("support") > 0)
    per = metrics.averaged(metrics.with_scores(conf), ["alpha", "fold"], "macro", metrics=("f1",))
    mean = per.groupBy("alpha").agg(F.lit(-1).cast("long").alias("fold"), F.avg("macro_f1").alias("macro_f1"))
    best_alpha = mean.orderBy(F.desc("macro_f1"), "alpha").limit(1).select("alpha").first()["alpha"]
    refit = models.RidgePipeline("embedding", "label", N_LABELS, alpha=best_alpha).fit(e).transform(e)
    train_acc = refit.agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0]
    res = per.unionByName(mean).withColumn("best", F.col("alpha") == F.lit(best_alpha))
    return res.withColumn("refit_train_accuracy", F.when(F.col("best") & (F.col("fold") == -1), F.lit(train_acc)))


# fixed values: the patterns whose matches per character are the features of a text, all RE2 and Java alike
PATTERNS = ["e", "a", "i", "o", "u", "n", "t", "h", "[áíóúñ]", "[äöüß]", "[èéêç]", "th", "ch", "qu", "ung", "the ",
            "[A-Z]", "[0-9]", "[#*$%&|<>]", "!", "[ \\t\\n]", "[.,;]", "(idiot|moron|clown|worthless)"]
REPRESENTATIONS = {"letters": list(range(16)), "shape": list(range(16, 23)), "all": list(range(23))}

# the same table in DuckDB: one row per (document, feature number, value), and the long labels
FEATURES = f"""lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
ft AS (SELECT doc_id, {", ".join(
    "len(regexp_extract_all(t, '" + p.replace("'", "''") + f"')) / greatest(length(t), 1)::DOUBLE AS x{n + 1}"
    for n, p in enumerate(PATTERNS))}
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents JOIN lab USING (doc_id))),
tl AS (SELECT doc_id, lang AS label FROM documents JOIN lab USING (doc_id) WHERE lang IS NOT NULL
       UNION ALL SELECT doc_id, 'quality' FROM documents JOIN lab USING (doc_id) WHERE quality = 1
       UNION ALL SELECT doc_id, 'toxic' FROM documents JOIN lab USING (doc_id) WHERE toxic = 1)"""


def document_features(spark, sf_dir):
    """(doc_id, x, lang, quality, toxic) of every labelled document; the labels join without the texts' shuffle
    growing beyond one exchange."""
    lab = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("t"))
    n = F.greatest(F.char_length("t"), F.lit(1)).cast("double")
    x = F.array(*[F.regexp_count("t", F.lit(p)) / n for p in PATTERNS])
    return d.select("doc_id", "lang", x.alias("x")).join(lab, "doc_id")


def document_targets(features):
    """The long (doc_id, label) table of the positives."""
    known = F.array_compact(F.array(F.col("lang"), F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")))
    return features.select("doc_id", F.explode(known).alias("label"))


def labelled(spark, sf_dir):
    """(doc_id, x, labels), written: features, joined to the positives of the long table."""
    f = cut_lineage(document_features(spark, sf_dir))
    return cut_lineage(multilabel.label_arrays(f.select("doc_id", "x"), document_targets(f), "doc_id"))


def label_vocabulary(rows):
    return [r["label"] for r in rows.select(F.explode("labels").alias("label")).distinct().orderBy("label").collect()]


@query("ridge_statistics", oracle=f"""
WITH {FEATURES},
v AS (UNPIVOT (SELECT doc_id, 1.0::DOUBLE AS x0, * EXCLUDE (doc_id) FROM ft) ON * EXCLUDE (doc_id) INTO NAME c VALUE x),
w AS (SELECT doc_id, CAST(substr(c, 2) AS INTEGER) AS pos, x FROM v),
k AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS "row" FROM (SELECT DISTINCT label FROM tl))
SELECT 'x' AS kind, a.pos AS "row", b.pos AS pos, round(sum(a.x * b.x), 6) AS val FROM w a JOIN w b USING (doc_id) GROUP BY ALL
UNION ALL
SELECT 'y', "row", pos, round(sum(x), 6) FROM tl JOIN k USING (label) JOIN w USING (doc_id) GROUP BY ALL
""")
def ridge_statistics(spark, sf_dir):
    """M3: the Gramian of [1, x] and the sums over every label's positives, which all ridge fits start from."""
    rows = labelled(spark, sf_dir)
    return multilabel.sums(rows, "x", "labels", label_vocabulary(rows)).select("kind", "row", "pos", "val")


@query("ridge_multilabel")
def ridge_multilabel(spark, sf_dir):
    """M1–M4 + M8: a pipeline of one ridge regression per label, fitted on all rows, saved, loaded and applied;
    long predictions (doc_id, label) beside the true positives."""
    from pyspark.ml import Pipeline, PipelineModel
    rows = labelled(spark, sf_dir)
    path = scratch_path(spark, "ridge-pipeline")
    Pipeline(stages=[multilabel.MultiLabelRidge(featuresCol="x", alpha=1.0)]).fit(rows).write().save(path)
    found = PipelineModel.load(path).transform(rows)
    true = multilabel.long_labels(found, "doc_id", "labels").withColumn("truth", F.lit(True))
    said = multilabel.long_labels(found, "doc_id", "predicted").withColumn("predicted", F.lit(True))
    return true.join(said, ["doc_id", "label"], "full").select(
        "doc_id", "label", F.coalesce("truth", F.lit(False)).alias("truth"),
        F.coalesce("predicted", F.lit(False)).alias("predicted"))


@query("ridge_label_metrics")
def ridge_label_metrics(spark, sf_dir):
    """A15–A17 over the predicted label sets: per label, macro and weighted rows."""
    found = cut_lineage(ridge_multilabel(spark, sf_dir))
    scored = cut_lineage(metrics.with_scores(metrics.confusion(found.filter("truth"), found.filter("predicted"), ["doc_id"]))
                         .filter("support > 0"))
    rows = scored.select("label", "precision", "recall", "f1")
    for kind in ("macro", "weighted"):
        mean = metrics.averaged(scored.withColumn("label", F.lit(f"({kind})")), ["label"], kind)
        rows = rows.unionByName(mean.select("label", *[F.col(f"{kind}_{m}").alias(m) for m in ("precision", "recall", "f1")]))
    return rows


def searched(spark, sf_dir):
    """Five repetitions of five iteratively stratified folds, each searched on its own train and validation rows."""
    rows = labelled(spark, sf_dir)
    folds = splits.iterative_folds(multilabel.long_labels(rows, "doc_id", "labels"), "doc_id", "label", k=5, reps=5)
    of = folds.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rep", "fold"))), lambda z: z["fold"]).alias("folds"))
    data = cut_lineage(rows.join(of, "doc_id").select("x", F.col("labels").alias("y"), "folds"))
    return multilabel.search(data, label_vocabulary(rows), REPRESENTATIONS, k=5, reps=5)


@query("ridge_search_cv")
def ridge_search_cv(spark, sf_dir):
    """M5–M7 + A14 + A16 + A17 + A22: per repetition and fold the trial chosen on the validation fold and its masked
    averages on the test fold after a fit on all other rows; fold -1 is the mean of a repetition."""
    s = cut_lineage(searched(spark, sf_dir).summary)
    scores = [c for c in s.columns if c.startswith(("macro_", "weighted_"))] + ["validation_f1"]
    mean = s.groupBy("rep").agg(*[F.avg(c).alias(c) for c in scores]).withColumn("fold", F.lit(-1).cast("long"))
    return s.unionByName(mean, allowMissingColumns=True)


@query("ridge_test_labels")
def ridge_test_labels(spark, sf_dir):
    """M7: counts and scores of every masked label on every test fold (the per-label table)."""
    return searched(spark, sf_dir).per_label


@query("ridge_trials")
def ridge_trials(spark, sf_dir):
    """M5: all trials of all searches with their validation scores; ``best`` marks the chosen one."""
    return searched(spark, sf_dir).trials
