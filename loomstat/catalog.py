"""The registry: the only place to edit datasets, variables, ranges, labels and thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import types as T


@dataclass(frozen=True)
class Dataset:
    """One input file: its logical name, file name and the measured columns taken from it, in order."""

    name: str
    file: str
    columns: tuple[str, ...]
    master: bool = False

    def schema(self, key: str) -> T.StructType:
        return T.StructType([T.StructField(c, T.DoubleType()) for c in (key, *self.columns)])


@dataclass(frozen=True)
class Thresholds:
    """Where the profile draws its lines."""

    # Fixed values
    high_missing_pct: float = 40.0  # above: high
    co_missing: float = 0.70  # |r| from here: co-missing
    heavy_skew: float = 2.0  # |skew| above: heavy
    moderate_skew: float = 1.0
    mild_fence: float = 1.5  # times the interquartile range
    extreme_fence: float = 3.0
    high_corr: float = 0.75  # |r| from here: high
    very_high_corr: float = 0.90
    min_pairs: int = 30  # complete pairs for a correlation
    min_values: int = 10  # values for a distribution


@dataclass(frozen=True)
class Derived:
    """A column computed by a SQL expression over ``inputs``; null where an input is, or a divisor is 0."""

    name: str
    expression: str
    inputs: tuple[str, ...]


@dataclass(frozen=True)
class Catalog:
    key: str
    datasets: tuple[Dataset, ...]
    demographics: tuple[str, ...]
    flags: tuple[str, ...]
    readings: dict[str, tuple[str, ...]]  # averaged column -> its repeated readings
    derived: tuple[Derived, ...]
    features: tuple[str, ...]
    ranges: dict[str, tuple[float, float]]
    labels: dict[str, dict[int, str]]  # code column -> code -> label
    bins: dict[str, tuple[tuple[float, float, str], ...]]  # column -> (above, up to, label)
    age_column: str
    age_range: tuple[float, float]
    valid_flag: tuple[str, int, tuple[str, ...]]  # flag, value that validates, columns it guards
    invalid_flag: tuple[str, int, tuple[str, ...]]  # flag, value that voids, columns it guards
    groups: dict[str, tuple[str, ...]]  # named subsets of features
    expected_missing: tuple[str, ...]
    redundant: tuple[tuple[str, str], ...]
    notes: dict[frozenset, str]
    shown: tuple[str, ...]  # features compared between groups
    thresholds: Thresholds = field(default_factory=Thresholds)

    def __post_init__(self) -> None:
        names = [d.name for d in self.datasets]
        if len(set(names)) != len(names):
            raise ValueError(f"dataset names repeat: {names}")
        if [d.name for d in self.datasets if d.master] != names[:1]:
            raise ValueError("the first dataset, and it alone, is the master")
        columns = [c for d in self.datasets for c in d.columns]
        if twice := sorted({c for c in columns if columns.count(c) > 1} | ({self.key} & set(columns))):
            raise ValueError(f"columns in more than one dataset: {twice}")
        made = {*columns, *self.readings, *(d.name for d in self.derived)}
        needed = {*self.features, *self.flags, *(c for r in self.readings.values() for c in r), *(c for d in self.derived for c in d.inputs)}
        if unknown := sorted(needed - made):
            raise ValueError(f"columns that no dataset or rule makes: {unknown}")

    @property
    def master(self) -> Dataset:
        return self.datasets[0]

    @cached_property
    def raw_readings(self) -> tuple[str, ...]:
        return tuple(c for columns in self.readings.values() for c in columns)

    def feature_sets(self) -> dict[str, tuple[str, ...]]:
        """The subsets of features in which complete cases are counted."""
        grouped = {c for columns in self.groups.values() for c in columns}
        without = {f"no_{g}": tuple(c for c in self.features if c not in columns) for g, columns in self.groups.items()}
        return {"all": self.features, "core": tuple(c for c in self.features if c not in grouped), **without}

    def role(self, column: str) -> str:
        """demographic, flag, raw_reading or feature."""
        if column in self.demographics or column == self.key:
            return "demographic"
        return "flag" if column in self.flags else "raw_reading" if column in self.raw_readings else "feature"


# The health survey's files, columns, codes, plausible ranges and known pairs.
SURVEY = Catalog(
    key="SEQN",
    datasets=(
        Dataset("demographics", "DEMO_J.csv", ("RIAGENDR", "RIDAGEYR", "RIDRETH3"), master=True),
        Dataset("body_measures", "BMX_J.csv", ("BMXBMI", "BMXWAIST")),
        Dataset("blood_pressure", "BPX_J.csv", ("BPXSY1", "BPXSY2", "BPXSY3", "BPXDI1", "BPXDI2", "BPXDI3", "BPXPLS")),
        Dataset("dexa_scan", "DXX_J.csv", ("DXAEXSTS", "DXDTOBMD", "DXDTOPF", "DXDTOLE")),
        Dataset("glucose", "GLU_J.csv", ("LBXGLU",)),
        Dataset("insulin", "INS_J.csv", ("LBXIN", "LBDINLC")),
        Dataset("hdl", "HDL_J.csv", ("LBDHDD",)),
        Dataset("cholesterol", "TCHOL_J.csv", ("LBXTC",)),
        Dataset(
            "biochemistry",
            "BIOPRO_J.csv",
            ("LBXSTR", "LBXSATSI", "LBXSAL", "LBXSTP", "LBXSTB", "LBXSCR", "LBXSUA", "LBXSBU", "LBXSCA", "LBXSPH", "LBXSNASI", "LBXSKSI"),
        ),
    ),
    demographics=("RIAGENDR", "RIDAGEYR", "RIDRETH3"),
    flags=("DXAEXSTS", "LBDINLC"),
    readings={"Avg_Systolic_BP": ("BPXSY1", "BPXSY2", "BPXSY3"), "Avg_Diastolic_BP": ("BPXDI1", "BPXDI2", "BPXDI3")},
    derived=(
        Derived("HOMA_IR", "LBXGLU * LBXIN / 405.0D", ("LBXGLU", "LBXIN")),
        Derived("TC_HDL_ratio", "try_divide(LBXTC, LBDHDD)", ("LBXTC", "LBDHDD")),
        Derived("TG_HDL_ratio", "try_divide(LBXSTR, LBDHDD)", ("LBXSTR", "LBDHDD")),
    ),
    features=(
        "BMXBMI", "BMXWAIST", "DXDTOBMD", "DXDTOPF", "DXDTOLE", "Avg_Systolic_BP", "Avg_Diastolic_BP", "BPXPLS",
        "LBXGLU", "LBXIN", "HOMA_IR", "LBXTC", "LBDHDD", "LBXSTR", "TC_HDL_ratio", "TG_HDL_ratio", "LBXSATSI",
        "LBXSAL", "LBXSTP", "LBXSTB", "LBXSCR", "LBXSUA", "LBXSBU", "LBXSCA", "LBXSPH", "LBXSNASI", "LBXSKSI",
    ),
    ranges={
        "BMXBMI": (10.0, 80.0),
        "BMXWAIST": (30.0, 200.0),
        "Avg_Systolic_BP": (60.0, 240.0),
        "Avg_Diastolic_BP": (20.0, 140.0),
        "BPXPLS": (25.0, 200.0),
        "DXDTOBMD": (0.30, 2.50),
        "DXDTOPF": (2.0, 70.0),
        "DXDTOLE": (5000.0, 120000.0),
        "LBXGLU": (40.0, 600.0),
        "LBXIN": (0.5, 500.0),
        "HOMA_IR": (0.0, 100.0),
        "LBXTC": (50.0, 500.0),
        "LBDHDD": (5.0, 200.0),
        "LBXSTR": (10.0, 5000.0),
        "TC_HDL_ratio": (1.0, 30.0),
        "TG_HDL_ratio": (0.1, 80.0),
        "LBXSATSI": (1.0, 500.0),
        "LBXSAL": (1.5, 6.0),
        "LBXSTP": (3.0, 12.0),
        "LBXSTB": (0.1, 20.0),
        "LBXSCR": (0.1, 20.0),
        "LBXSUA": (0.5, 20.0),
        "LBXSBU": (1.0, 150.0),
        "LBXSCA": (5.0, 15.0),
        "LBXSPH": (0.5, 10.0),
        "LBXSNASI": (100.0, 175.0),
        "LBXSKSI": (2.0, 8.0),
    },
    labels={
        "RIAGENDR": {1: "Male", 2: "Female"},
        "RIDRETH3": {
            1: "Mexican American",
            2: "Other Hispanic",
            3: "Non-Hispanic White",
            4: "Non-Hispanic Black",
            6: "Non-Hispanic Asian",
            7: "Other/Multiracial",
        },
    },
    bins={"RIDAGEYR": ((19.0, 39.0, "20-39"), (39.0, 59.0, "40-59"), (59.0, 80.0, "60-80"))},
    age_column="RIDAGEYR",
    age_range=(20.0, 80.0),
    valid_flag=("DXAEXSTS", 1, ("DXDTOBMD", "DXDTOPF", "DXDTOLE")),
    invalid_flag=("LBDINLC", 1, ("LBXIN",)),
    groups={"dexa": ("DXDTOBMD", "DXDTOPF", "DXDTOLE"), "fasting": ("LBXGLU", "LBXIN", "HOMA_IR")},
    expected_missing=("DXDTOBMD", "DXDTOPF", "DXDTOLE", "DXAEXSTS", "LBXGLU", "LBXIN", "HOMA_IR", "LBDINLC"),
    redundant=(("LBXTC", "TC_HDL_ratio"), ("LBXSTR", "TG_HDL_ratio"), ("LBXIN", "HOMA_IR"), ("LBXGLU", "HOMA_IR")),
    notes={
        frozenset({"LBXTC", "TC_HDL_ratio"}): "the ratio is computed from total cholesterol",
        frozenset({"LBXSTR", "TG_HDL_ratio"}): "the ratio is computed from triglycerides",
        frozenset({"LBXIN", "HOMA_IR"}): "HOMA_IR is computed from insulin",
        frozenset({"LBXGLU", "HOMA_IR"}): "HOMA_IR is computed from glucose",
        frozenset({"BPXSY1", "Avg_Systolic_BP"}): "the average holds the first reading",
        frozenset({"BPXDI1", "Avg_Diastolic_BP"}): "the average holds the first reading",
    },
    shown=(
        "BMXBMI", "BMXWAIST", "Avg_Systolic_BP", "Avg_Diastolic_BP", "LBXTC", "LBDHDD", "LBXSTR", "LBXGLU", "HOMA_IR",
        "DXDTOBMD", "DXDTOPF", "LBXSCR", "LBXSUA",
    ),
)
