"""Parameters that change results, with the values analyses run under unless told otherwise."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Params:
    seed: int = 42
    permutations: int = 999
    null_permutations: int = 99
    min_species_occurrence: int = 3
    iqr_multiplier: float = 1.5
    correlation_flag: float = 0.7
    crs_epsg: int = 4326
    bbox: tuple[float, float, float, float] = (88.7, 26.7, 92.2, 28.4)
    scale_threshold: float = 80.0
    significance: float = 0.05
    top_species: int = 200
    #: Half-open elevation bands in metres: (lower, upper, label) (fixed values).
    bands: tuple[tuple[float, float, str], ...] = (
        (0, 500, "<500 m"), (500, 1000, "500–1k m"), (1000, 1500, "1k–1.5k m"), (1500, 2000, "1.5k–2k m"), (2000, 2500, "2k–2.5k m"),
        (2500, 3000, "2.5k–3k m"), (3000, 3500, "3k–3.5k m"), (3500, 4000, "3.5k–4k m"), (4000, 6000, ">4k m"),
    )
    #: Keywords by which a predictor belongs to a group, first group first (fixed values).
    variable_groups: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("climate", ("bio", "mat", "map", "prec", "temp", "arid")),
        ("topography", ("elevation", "slope", "aspect", "dem", "altitude")),
        ("soil", ("soil", "fao", "clay", "sand", "ph", "bulk")),
    )
    strata: tuple[str, ...] = ("Trees", "Shrubs", "Herbs", "Regeneration")
    #: Headers a canonical column may come under, most wanted first (fixed values).
    headers: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "plot_id": ("plot_id", "plotid", "plot_no", "plot_number", "plotcode", "plot_code", "nfi_plot_number", "plot#", "plot"),
        "species_name": ("species_name", "scientific_name", "species", "sp_name"),
        "stratum": ("stratum", "layer", "vegetation_layer"),
        "longitude": ("longitude", "lon", "long", "x", "lon_dd"),
        "latitude": ("latitude", "lat", "y", "lat_dd"),
        "forest_type": ("forest_type", "fortyp", "for_typ", "foresttype"),
        "abundance": ("abundance", "count", "individuals", "n", "shrub_individuals_count", "herb_individuals_count"),
    })


DEFAULTS = Params()
