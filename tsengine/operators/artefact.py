"""One artefact of a linear model (S19): feature list, scaler, selection and coefficients as a Spark ML
estimator and model of their own, saved and loaded as such, alone or inside a pipeline.

A fit reads the rows once: scaler, F scores and coefficients all come from one Gram matrix of the
features and the target, whose size is that of the feature list.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsengine.operators import linear as L


class _Linear(HasLabelCol, HasPredictionCol):
    featureCols = Param(Params._dummy(), "featureCols", "ordered feature columns", TypeConverters.toListString)

    def features(self) -> list[str]:
        return self.getOrDefault(self.featureCols)


class LinearEstimator(Estimator, _Linear, DefaultParamsReadable, DefaultParamsWritable):
    """``solver`` of the linear family on the ``k`` features of highest F score (all if ``k`` is 0), each
    scaled by its mean and population deviation over the rows without a missing value."""

    solver = Param(Params._dummy(), "solver", "linear_regression, ridge, lasso, elastic_net or bayesian_ridge", TypeConverters.toString)
    alpha = Param(Params._dummy(), "alpha", "penalty", TypeConverters.toFloat)
    l1Ratio = Param(Params._dummy(), "l1Ratio", "share of the absolute penalty", TypeConverters.toFloat)
    k = Param(Params._dummy(), "k", "features kept, 0 for all", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featureCols: Sequence[str] = (), labelCol: str = "label", predictionCol: str = "prediction",
                 solver: str = "ridge", alpha: float = 1.0, l1Ratio: float = 0.5, k: int = 0):
        super().__init__()
        self._setDefault(featureCols=[], labelCol="label", predictionCol="prediction", solver="ridge", alpha=1.0, l1Ratio=0.5, k=0)
        self._set(**{name: list(v) if name == "featureCols" else v for name, v in self._input_kwargs.items()})

    def _fit(self, dataset: DataFrame) -> LinearArtefact:
        names, label = self.features(), self.getLabelCol()
        means = L.column_means(dataset, [*names, label])
        blocks = L.gram_blocks(dataset.withColumn("_all", F.lit(0)), names, label, ["_all"], means)
        if not blocks:
            raise ValueError("no row without a missing feature or label")
        gram = blocks[(0,)]
        sxx, sxy, syy, xbar, ybar = gram.centered()
        scale = np.sqrt(np.clip(np.diag(sxx) / gram.n, 0.0, None))
        with np.errstate(divide="ignore", invalid="ignore"):
            # F grows with the squared correlation; a constant feature has none
            r2 = np.where(scale > 0, sxy ** 2 / (np.diag(sxx) * syy), -1.0) if syy > 0 else np.zeros(len(names))
        k = self.getOrDefault(self.k) or len(names)
        kept = sorted(sorted(range(len(names)), key=lambda i: (-r2[i], names[i]))[:k])
        scale[scale == 0] = 1.0
        at = np.array([0, *[i + 1 for i in kept], len(names) + 1])
        factor = np.concatenate([[1.0], 1.0 / scale[kept], [1.0]])
        sub = L.Gram(gram.G[np.ix_(at, at)] * np.outer(factor, factor))
        fit = L.SOLVERS[self.getOrDefault(self.solver)](sub, {"alpha": self.getOrDefault(self.alpha), "l1_ratio": self.getOrDefault(self.l1Ratio)})
        # the Gram is shifted by the means: what is left of them in it goes back
        centre = np.array([means[names[i]] for i in kept]) + xbar[kept]
        intercept = fit.intercept + means[label] + float(fit.coef @ (xbar[kept] / scale[kept]))
        model = LinearArtefact(featureCols=names, labelCol=label, predictionCol=self.getPredictionCol(), kept=kept, means=centre.tolist(),
                               scales=scale[kept].tolist(), coefficients=[float(b) for b in fit.coef], intercept=float(intercept))
        return self._copyValues(model)


class LinearArtefact(Model, _Linear, DefaultParamsReadable, DefaultParamsWritable):
    """Prediction = intercept + sum of coefficient * (x - mean) / scale over the kept features; null where one is missing."""

    kept = Param(Params._dummy(), "kept", "positions of the kept features", TypeConverters.toListInt)
    means = Param(Params._dummy(), "means", "means of the kept features", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "deviations of the kept features", TypeConverters.toListFloat)
    coefficients = Param(Params._dummy(), "coefficients", "coefficients of the kept features, scaled", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "prediction at the means", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featureCols: Sequence[str] = (), labelCol: str = "label", predictionCol: str = "prediction", kept: Sequence[int] = (),
                 means: Sequence[float] = (), scales: Sequence[float] = (), coefficients: Sequence[float] = (), intercept: float = 0.0):
        super().__init__()
        self._setDefault(featureCols=[], labelCol="label", predictionCol="prediction", kept=[], means=[], scales=[], coefficients=[], intercept=0.0)
        self._set(**{name: list(v) if isinstance(v, (list, tuple)) else v for name, v in self._input_kwargs.items()})

    def selected(self) -> list[str]:
        return [self.features()[i] for i in self.getOrDefault(self.kept)]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = F.lit(self.getOrDefault(self.intercept))
        for name, mean, scale, coef in zip(self.selected(), self.getOrDefault(self.means), self.getOrDefault(self.scales),
                                           self.getOrDefault(self.coefficients), strict=True):
            out = out + F.lit(coef) * ((F.col(name) - F.lit(mean)) / F.lit(scale))
        return dataset.withColumn(self.getPredictionCol(), out)
