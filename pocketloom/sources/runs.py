"""What a run leaves behind, on whatever file system its folder is: settings, JSON, tables, text results and plots."""

from __future__ import annotations

import json
from io import BytesIO
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pocketloom.operators.contracts import ContractError
from pocketloom.sources.experiments import Section
from pocketloom.sources.files import exists, is_folder, joined, write_bytes, write_text
from pocketloom.sources.tables import write_single_csv

#: Cells of a scatter plot on either side; predictions are counted by cell before they are brought to the driver.
CELLS = 300


class Run:
    """The folder of a run. Everything in it is written through here."""

    def __init__(self, spark: SparkSession, folder: str | Path) -> None:
        self.spark, self.folder = spark, str(folder)

    @classmethod
    def begin(cls, spark: SparkSession, folder: str | Path, overwrite: bool = False, settings: str | Path | None = None) -> Run:
        """A run in a folder that is free, or may be written over; its settings file is kept in it."""
        run = cls(spark, folder)
        if exists(spark, folder) and not is_folder(spark, folder):
            raise FileExistsError(f"{folder} is no folder")
        if exists(spark, folder) and not overwrite:
            raise FileExistsError(f"{folder} exists already")
        if settings is not None:
            joined(spark, "", [str(settings)], run.path("experiment.json"))
        return run

    def path(self, *names: str) -> str:
        return "/".join([self.folder, *names])

    def text(self, name: str, content: str) -> str:
        write_text(self.spark, self.path(name), content)
        return self.path(name)

    def json(self, name: str, data: object) -> str:
        """Keys in order; sections as objects, paths as text."""

        def other(value: object) -> object:
            if isinstance(value, Section):
                return value.plain()
            if isinstance(value, Path):
                return str(value)
            raise TypeError(f"{type(value).__name__} has no JSON form")

        return self.text(name, json.dumps(data, indent=2, sort_keys=True, default=other) + "\n")

    def table(self, name: str, df: DataFrame) -> str:
        return write_single_csv(df, self.path(name))

    def results(self, split: str, values: dict[str, object]) -> str:
        return self.text(f"results_{split}.txt", "".join(f"{k}: {v}\n" for k, v in {"split": split, **values}.items()))

    def split_outputs(self, predictions: DataFrame, metrics: dict[str, dict], splits: tuple[str, ...] | list[str], order: list[str], skip_empty: bool, tables: bool = True) -> None:
        """For each split its results as text, a scatter plot where matplotlib is installed, and, unless tables is
        False, its predictions as CSV. A split without predictions is left out or, if not skip_empty, has NaN."""
        nan = float("nan")
        for s in splits:
            values = metrics.get(s)
            if values is None and skip_empty:
                continue
            own = predictions.where(F.col("split") == s)
            if tables:
                self.table(f"predict_vs_true_affinity_{s}.csv", own.orderBy(*order))
            self.results(s, values or {"num_examples": 0, "pearson_r": nan, "rmse": nan, "mae": nan})
            if values:
                self.scatter(f"scatter_{s}.png", own, f"{s}: Pearson r = {values['pearson_r']:.3f}")

    def scatter(self, name: str, predictions: DataFrame, title: str) -> str | None:
        """Predicted against true affinity with the line of equality; None where matplotlib is missing."""
        plt = _pyplot()
        if plt is None:
            return None
        cells = by_cell(predictions, "true_affinity", "predicted_affinity").toPandas()
        ends = [cells.min().min(), cells.max().max()]
        figure, axes = plt.subplots(figsize=(5, 5))
        axes.scatter(cells["x"], cells["y"], s=12)
        axes.plot(ends, ends, linestyle="--")
        axes.set(xlabel="true affinity", ylabel="predicted affinity", title=title)
        return self._picture(name, figure, plt)

    def losses(self, name: str, history: list[dict]) -> str | None:
        """Train and validation loss by epoch; no history is an error, a series without values is left out."""
        if not history:
            raise ContractError("there is no loss history to plot")
        plt = _pyplot()
        if plt is None:
            return None
        figure, axes = plt.subplots()
        for series in ("train_loss", "val_loss"):
            points = [(h["epoch"], h[series]) for h in sorted(history, key=lambda h: h["epoch"]) if h.get(series) is not None]
            if points:
                axes.plot(*zip(*points), label=series)
        axes.set(xlabel="epoch", ylabel="loss", title="Train and validation loss")
        axes.legend()
        return self._picture(name, figure, plt)

    def _picture(self, name: str, figure, plt) -> str:
        out = BytesIO()
        figure.savefig(out, format="png")
        plt.close(figure)
        write_bytes(self.spark, self.path(name), out.getvalue())
        return self.path(name)


def by_cell(df: DataFrame, x: str, y: str, cells: int = CELLS) -> DataFrame:
    """(x, y, n): the middles of the cells of a grid over all points, and how many points lie in each: cells squared at
    most, however many rows there are."""
    lo, hi, low, high = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()

    def middle(c: str, lo: float | None, hi: float | None):
        if lo is None or hi <= lo:
            return F.col(c)
        step = (hi - lo) / cells
        return F.lit(lo) + (F.least(F.floor((F.col(c) - lo) / step), F.lit(cells - 1)) + 0.5) * step

    return df.groupBy(middle(x, lo, hi).alias("x"), middle(y, low, high).alias("y")).agg(F.count(F.lit(1)).alias("n"))


def _pyplot():
    try:
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot as plt
    except ImportError:
        return None
    return plt


def first_metric(metrics: dict[str, object], names: tuple[str, ...]) -> float | None:
    """The first of names that has a value, as a float."""
    return next((float(metrics[n]) for n in names if metrics.get(n) is not None), None)
