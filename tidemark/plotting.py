"""Plots of a forecast of one series; needs matplotlib, which is imported only here and only when asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _axes(count: int):
    try:
        from matplotlib import pyplot
    except ImportError as error:
        raise ImportError("plots need matplotlib") from error
    return pyplot.subplots(count, 1, figsize=(10, 3 * count), squeeze=False)


def plot(forecast: DataFrame, history: DataFrame | None = None):
    """yhat with its interval, over the training points if given."""
    figure, ((ax,),) = _axes(1)
    rows = forecast.select("ds", "yhat", "yhat_lower", "yhat_upper").toPandas().sort_values("ds")
    if history is not None:
        past = history.select("ds", "y").toPandas()
        ax.plot(past["ds"], past["y"], "k.", markersize=3)
    ax.plot(rows["ds"], rows["yhat"])
    ax.fill_between(rows["ds"], rows["yhat_lower"], rows["yhat_upper"], alpha=0.2)
    return figure


def plot_components(forecast: DataFrame):
    """Trend, weekly and yearly, each in a panel; components that are zero throughout are left out."""
    rows = forecast.select("ds", "trend", "weekly", "yearly").toPandas().sort_values("ds")
    shown = [c for c in ("trend", "weekly", "yearly") if c == "trend" or rows[c].abs().max() > 0]
    figure, axes = _axes(len(shown))
    for (ax,), name in zip(axes, shown, strict=True):
        ax.plot(rows["ds"], rows[name])
        ax.set_ylabel(name)
    return figure
