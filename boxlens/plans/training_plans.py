"""Training as a query: a latent machine of two components over vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from boxlens.operators import training
from boxlens.operators.cache import SUPPORT_MARGIN
from boxlens.plans.registry import query
from boxlens.sources.fixtures import read
from boxlens.tables import Workspace

#: Labels under it are foreground; cost of a unit of loss; rounds, minings of a round, steps of a solve.
FOREGROUND, COST, ROUNDS, MININGS, STEPS = 5, 0.01, 3, 2, 12
COMPONENTS = 2


class Latent:
    """A foreground vector is in the component that scores it best, a background vector must score low in both. An output's features are the vector and 1 in its component's place."""

    def __init__(self, rows):
        one = F.concat(F.transform("embedding", lambda x: x.cast("double")), F.array(F.lit(1.0)))
        self.rows = rows.select(F.col("vec_id").alias("example_id"), (F.col("label") < FOREGROUND).alias("foreground"), one.alias("x"))
        self.size = self.rows.agg(F.max(F.size("x"))).first()[0]
        self.zero = F.array_repeat(F.lit(0.0), COMPONENTS * self.size)

    def start(self) -> np.ndarray:
        """Components that look in opposite directions."""
        w = np.zeros(COMPONENTS * self.size)
        w[0], w[self.size] = 0.1, -0.1
        return w

    def score(self, w: np.ndarray, c: int):
        own = F.array(*[F.lit(float(v)) for v in w[c * self.size : (c + 1) * self.size]])
        return F.aggregate(F.zip_with("x", own, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    def features(self, c: int):
        blank = lambda n: F.array_repeat(F.lit(0.0), n * self.size)
        return F.concat(blank(c), F.col("x"), blank(COMPONENTS - 1 - c))

    def relabel(self, w: np.ndarray):
        """Of each foreground vector its best component's features, which are the belief, and the empty output, which costs 1."""
        own = self.rows.where("foreground")
        belief = own.select("example_id", F.lit(True).alias("is_belief"), F.lit(0.0).alias("loss"), F.when(self.score(w, 0) >= self.score(w, 1), self.features(0)).otherwise(self.features(1)).alias("x"))
        return belief.unionByName(own.select("example_id", F.lit(False).alias("is_belief"), F.lit(1.0).alias("loss"), self.zero.alias("x")))

    def mine(self, w: np.ndarray):
        """Of each background vector the components that score it over -1, and the empty output as belief."""
        scored = self.rows.where("not foreground").select("example_id", "x", F.array(*[F.struct(self.score(w, c).alias("s"), self.features(c).alias("f")) for c in range(COMPONENTS)]).alias("o"))
        hard = scored.select("example_id", F.explode(F.filter("o", lambda o: o["s"] > -1)).alias("o")).select("example_id", F.lit(False).alias("is_belief"), F.lit(1.0).alias("loss"), F.col("o.f").alias("x"))
        return hard.unionByName(hard.select("example_id", F.lit(True).alias("is_belief"), F.lit(0.0).alias("loss"), self.zero.alias("x")).distinct())

    def keep(self, cache, w: np.ndarray):
        """Rows that lie further under their belief than a support vector go, but for beliefs and empty outputs."""
        own = F.array(*[F.lit(float(v)) for v in w])
        score = F.aggregate(F.zip_with("x", own, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return cache.where(F.col("is_belief") | ~F.exists("x", lambda v: v != 0) | (score + F.col("loss") > -SUPPORT_MARGIN))


@query()
def latent_train(spark, sf_dir):
    """(round, step, cached, whole): the objective on the cache after each solve, and with all that is mined then."""
    model, log = Latent(read(spark, sf_dir, "embeddings")), []
    regularisation = np.ones(COMPONENTS * model.size)
    training.train(model.start(), model.relabel, model.mine, model.keep, COST, regularisation, ROUNDS, MININGS, Workspace(spark, "latent").root, inner=STEPS, log=log)
    return spark.createDataFrame([(r, s, round(float(v), 6), round(float(f), 6)) for r, s, v, f in log], "round int, step int, cached double, whole double")
