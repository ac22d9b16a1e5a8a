"""Typed settings with defaults, and the two presets."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, fields, replace

# fixed values: label vocabulary of the input data, and the presets below
UNLABELLED = (0, 1)
DYNAMIC = (252, 253, 254, 255, 256, 257, 258, 259)
GROUND = (40, 44, 48, 49, 71, 72)
BUILDING = (50, 51, 52, 60)
TREE = (70, 80, 81)

BUILDING_TYPE, TREE_TYPE, CAR_TYPE = 0, 1, 2
MOVING, STATIC, UNKNOWN = 1, 0, -1


@dataclass(frozen=True)
class Settings:
    skip: int = 2
    start: int = 5
    end: int = 50
    sensor_height: float = 2.0
    min_dis: float = 0.0
    max_dis: float = 50.0
    min_angle: float = 0.0
    max_angle: float = 360.0
    min_azimuth: float = -30.0
    max_azimuth: float = 60.0
    range_res: float = 0.2
    sector_res: float = 1.2
    azimuth_res: float = 2.0
    max_z: float = 1.0
    min_z: float = -1.0
    car_square: float = 2.0
    max_intensity: float = 200.0
    iteration: int = 3
    search_c: int = 2
    to_be_class: int = 1
    intensity_diff: float = 50.0
    intensity_cov: float = 20.0
    occupancy: float = 0.6
    wrap_sectors: bool = False
    dynamic_label: tuple[int, ...] = ()
    # what eigen features are divided by, see operators/features.py
    k_linearity_max: float = 740.0
    k_planarity_max: float = 959.0
    k_scattering_max: float = 1248.0
    k_omnivariance_max: float = 0.278636
    k_anisotropy_max: float = 1248.0
    k_eigen_entropy_max: float = 0.956129
    k_change_of_curvature_max: float = 0.99702
    #: Neighbours of a point, itself included, that its normal is taken from.
    search_num: int = 10
    #: Scanner to camera, row-major 4x4.
    tr: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)

    @property
    def range_num(self) -> int:
        return math.ceil(round((self.max_dis - self.min_dis) / self.range_res, 9))

    @property
    def sector_num(self) -> int:
        return math.ceil(round((self.max_angle - self.min_angle) / self.sector_res, 9))

    @property
    def azimuth_num(self) -> int:
        return math.ceil(round((self.max_azimuth - self.min_azimuth) / self.azimuth_res, 9))

    def but(self, **values) -> "Settings":
        return replace(self, **values)

    @staticmethod
    def from_mapping(values: dict) -> "Settings":
        """Settings from a parsed configuration file, with or without sections; a name may end in an underscore.

        Unknown names are ignored, missing ones keep their defaults, and every value takes its default's type.
        """
        defaults = {f.name: f.default for f in fields(Settings)}
        flat = {}
        for name, value in values.items():
            flat |= value if isinstance(value, dict) else {name: value}
        named = {re.sub("([A-Z])", r"_\1", k).lower().strip("_"): v for k, v in flat.items()}
        return Settings(**{k: type(defaults[k])(v) for k, v in named.items() if k in defaults})

    @staticmethod
    def from_file(path: str) -> "Settings":
        """Settings from a YAML file on the driver."""
        import yaml

        with open(path) as f:
            return Settings.from_mapping(yaml.safe_load(f) or {})


_MAXIMA = {"k_linearity_max": 288.9, "k_planarity_max": 288.9, "k_scattering_max": 2889.9}

ROAD = Settings(
    skip=5, start=4320, end=4535, sensor_height=1.73, min_dis=1.5, max_dis=30.0, min_azimuth=-40.0, max_azimuth=80.0, range_res=0.4, max_z=0.8, min_z=-1.2, car_square=30.0,
    max_intensity=255.0, to_be_class=10, intensity_diff=2.0, intensity_cov=1.0, occupancy=0.4, **_MAXIMA,
)
PARKING = Settings(
    skip=1, start=5, end=700, sensor_height=1.83, min_dis=0.8, max_dis=40.0, range_res=0.4, max_intensity=255.0, to_be_class=6, intensity_diff=2.0, intensity_cov=1.0, occupancy=0.8,
    **_MAXIMA,
)
