"""Settings of the engine and of single sites."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from datetime import date


@dataclass(frozen=True)
class BoostSettings:
    """Gradient boosting: rounds of trees, their size, penalties and samples."""

    rounds: int = 400
    depth: int = 6
    rate: float = 0.05
    min_weight: float = 3
    l1: float = 0.1
    l2: float = 1.0
    min_gain: float = 0.1
    subsample: float = 0.85
    tree_columns: float = 0.85
    columns: float = 0.8


@dataclass(frozen=True)
class ForestSettings:
    trees: int = 400
    depth: int = 12
    min_split: int = 5
    min_leaf: int = 3
    columns: float = 0.85


@dataclass(frozen=True)
class SiteSettings:
    """What a site has of its own: None, or an empty list of features, leaves the general setting.

    ``boosted`` and ``forest`` are changes to the general learners, ``grid`` the changes that tuning tries.
    """

    boosted_weight: float = 0.56
    forest_weight: float = 0.44
    naive_weight: float = 0.0
    clip_quantile: float | None = None
    cap: float | None = None
    features: tuple[str, ...] = ()
    boosted: dict | None = None
    forest: dict | None = None
    grid: tuple[dict, ...] = ()


#: Groups of features that sites choose from. Those that a frame doesn't have are passed over.
PERSISTED = ("last_observed", "weeks_since_spike")
SHORT_LAGS = ("prev_obs_1", "prev_obs_2", "prev_obs_diff")
ALL_LAGS = ("prev_obs_1", "prev_obs_2", "prev_obs_3", "prev_obs_4", "prev_obs_2_weeks", "prev_obs_3_weeks", "prev_obs_diff")
SHORT_ROLLS = ("roll_mean_4", "roll_max_4")
ALL_ROLLS = ("roll_mean_4", "roll_std_4", "roll_max_4", "roll_std_8", "roll_max_8", "roll_std_12", "roll_max_12")
CALENDAR = ("sin_day_of_year", "cos_day_of_year", "month")
SEA = ("sst", "pdo", "beuti")
CLIMATE = ("oni", "sst_anom", "discharge")
CELLS = ("pn_log",)
FEW = (*PERSISTED, "prev_obs_1", "month", "sst", "pdo")
MINIMAL = ("last_observed", "prev_obs_1", "month", "sst")

#: The forest of sites where forests do badly.
CAUTIOUS_FOREST = dict(trees=200, depth=6, min_split=10, min_leaf=5, columns=0.5)


def _boost(rounds: int, depth: int, rate: float, min_weight: float, l1: float, l2: float, min_gain: float, share: float) -> dict:
    return dict(rounds=rounds, depth=depth, rate=rate, min_weight=min_weight, l1=l1, l2=l2, min_gain=min_gain, subsample=share, tree_columns=share)


def _tried(rounds: int, depth: int, rate: float, min_weight: float) -> dict:
    return dict(rounds=rounds, depth=depth, rate=rate, min_weight=min_weight)


#: Blend weights (boosted, forest, naive), bounds, features and learners by site key.
SITES = {
    "copalis": SiteSettings(
        0.0, 1.0, 0.0, 0.97, None, (*PERSISTED, *SHORT_LAGS, *SHORT_ROLLS, *CALENDAR, *CLIMATE),
        _boost(100, 2, 0.03, 10, 1.0, 5.0, 1.0, 0.7), None, (_tried(100, 2, 0.03, 10),)),
    "kalaloch": SiteSettings(
        0.0, 1.0, 0.0, 0.95, 80.0, (*PERSISTED, *SHORT_LAGS, *CALENDAR, *CLIMATE, *CELLS),
        _boost(80, 2, 0.02, 12, 2.0, 10.0, 2.0, 0.6), None, (_tried(80, 2, 0.02, 12),)),
    "twin harbors": SiteSettings(
        0.0, 1.0, 0.0, 0.98, None, (*PERSISTED, *ALL_LAGS, *SHORT_ROLLS, "sst", "pdo", *CALENDAR, *CLIMATE),
        _boost(150, 3, 0.03, 8, 0.5, 3.0, 0.5, 0.8), None, (_tried(150, 3, 0.03, 8), _tried(100, 2, 0.03, 10))),
    "quinault": SiteSettings(
        0.0, 1.0, 0.0, 0.98, None, (*PERSISTED, *ALL_LAGS, *SHORT_ROLLS, *SEA, *CALENDAR, *CLIMATE),
        _boost(200, 3, 0.03, 7, 0.3, 2.0, 0.3, 0.8), None, (_tried(200, 3, 0.03, 7), _tried(150, 2, 0.05, 10))),
    "long beach": SiteSettings(
        1.0, 0.0, 0.0, 0.98, None, (*PERSISTED, *ALL_LAGS, *ALL_ROLLS, *SEA, *CALENDAR, *CLIMATE),
        _boost(250, 3, 0.03, 7, 0.3, 2.0, 0.3, 0.8), None, (_tried(250, 3, 0.03, 7), _tried(200, 4, 0.05, 5))),
    "clatsop beach": SiteSettings(1.0, 0.0),
    "coos bay": SiteSettings(
        0.0, 1.0, 0.0, 0.97, None, FEW, _boost(80, 2, 0.02, 15, 2.0, 10.0, 2.0, 0.6), CAUTIOUS_FOREST, (_tried(80, 2, 0.02, 15),)),
    "cannon beach": SiteSettings(
        0.0, 1.0, 0.0, 0.95, 80.0, (*FEW, "prev_obs_2"), _boost(80, 2, 0.02, 12, 1.5, 7.0, 1.5, 0.6), CAUTIOUS_FOREST, (_tried(80, 2, 0.02, 12),)),
    "gold beach": SiteSettings(
        1.0, 0.0, 0.0, 0.95, None, FEW, _boost(100, 2, 0.02, 15, 2.0, 10.0, 2.0, 0.6), CAUTIOUS_FOREST, (_tried(100, 2, 0.02, 15),)),
    "newport": SiteSettings(
        1.0, 0.0, 0.0, 0.98, None, FEW, _boost(100, 2, 0.02, 15, 2.0, 10.0, 2.0, 0.6), CAUTIOUS_FOREST, (_tried(100, 2, 0.02, 15),)),
}

#: What tuning tries at every site.
GRID = (_tried(500, 4, 0.05, 5), _tried(400, 6, 0.05, 3))


@dataclass(frozen=True)
class EngineConfig:
    """What a run depends on; one instance per experiment."""

    horizon_weeks: int = 1
    min_training: int = 10
    seed: int = 42
    test_fraction: float = 0.20
    history_fraction: float = 0.33
    min_history: int = 10
    holdout_from: date | None = None
    clip_quantile: float | None = 0.99
    anchor_max_age_days: int = 28
    lags: tuple[int, ...] = (1, 2, 3, 4)
    da_decay: float = 0.2
    pn_decay: float = 0.3
    boosted: BoostSettings = BoostSettings()
    forest: ForestSettings = ForestSettings()
    spikes: BoostSettings = BoostSettings(300, 4, 0.05, 3, 0.5, 1.0, 0.1, 0.85, 0.85, 1.0)
    classes: BoostSettings = BoostSettings(500, 7, 0.03, 5, 0.1, 2.0, 0.2, 0.9, 0.9, 0.8)
    bootstrap_rounds: int = 100
    per_site: bool = True
    use_interpolated: bool = True
    monotone: bool = True
    derived_features: bool = True
    drop_features: tuple[str, ...] = ()
    sites: dict[str, SiteSettings] = field(default_factory=lambda: dict(SITES))

    def __post_init__(self) -> None:
        if not 0 < self.test_fraction <= 1 or not 0 <= self.history_fraction <= 1:
            raise ValueError("fractions must lie within 0 and 1")
        if self.horizon_weeks < 1 or self.min_training < 2 or self.min_history < 1:
            raise ValueError("the horizon and history must be one at least and a training set two rows")
        if self.clip_quantile is not None and not 0 < self.clip_quantile <= 1:
            raise ValueError("the clip quantile must lie within 0 and 1")
        if any(k < 1 for k in self.lags) or len(set(self.lags)) != len(self.lags):
            raise ValueError("lags must be distinct and one at least")
        if min(self.da_decay, self.pn_decay) < 0 or self.bootstrap_rounds < 0:
            raise ValueError("decay rates and rounds must not be negative")

    def with_options(self, options: Mapping[str, str]) -> EngineConfig:
        """The configuration with options given as text, as an environment holds them; an unknown name is an error.

        ``lags`` are numbers or ``none``, ``clip_quantile`` a number or ``none`` (then at single sites too),
        ``forest`` a JSON object of ForestSettings, ``features`` is ``all`` or ``minimal`` for single sites,
        ``drop_features`` names, ``holdout_from`` a date; the others are numbers, ``true`` or ``false``.
        """
        config = self
        for name, text in options.items():
            text = text.strip()
            if name == "lags":
                config = config.but(lags=() if text == "none" else tuple(int(k) for k in text.split(",")))
            elif name == "clip_quantile":
                quantile = None if text == "none" else float(text)
                config = config.at_sites(clip_quantile=quantile, cap=None).but(clip_quantile=quantile)
            elif name == "forest":
                config = config.but(forest=replace(config.forest, **json.loads(text)))
            elif name == "features":
                config = config.at_sites(features={"all": (), "minimal": MINIMAL}[text])
            elif name == "drop_features":
                config = config.but(drop_features=tuple(f.strip() for f in text.split(",") if f.strip()))
            elif name == "holdout_from":
                config = config.but(holdout_from=date.fromisoformat(text))
            elif isinstance(getattr(config, name, None), bool):
                config = config.but(**{name: {"true": True, "false": False}[text.lower()]})
            elif isinstance(getattr(config, name, None), (int, float)):
                config = config.but(**{name: type(getattr(config, name))(text)})
            else:
                raise ValueError(f"no such option: {name}")
        return config

    def site(self, name: str) -> SiteSettings:
        return self.sites.get(name, SiteSettings()) if self.per_site else SiteSettings()

    def boosted_at(self, name: str) -> BoostSettings:
        return replace(self.boosted, **(self.site(name).boosted or {}))

    def forest_at(self, name: str) -> ForestSettings:
        return replace(self.forest, **(self.site(name).forest or {}))

    def at_sites(self, **changes) -> EngineConfig:
        """The configuration with the same changes to the settings of every single site."""
        return replace(self, sites={name: replace(own, **changes) for name, own in self.sites.items()})

    def but(self, **changes) -> EngineConfig:
        return replace(self, **changes)


#: Models by task and what they are.
MODELS = {
    "regression": {"ensemble": "weighted blend", "xgboost": "gradient-boosted trees", "rf": "random forest", "naive": "last known value", "linear": "ridge regression"},
    "classification": {"ensemble": "categories of the blend", "xgboost": "categories by boosted trees", "rf": "categories of the forest", "naive": "category of the last value", "logistic": "softmax regression"},
}
