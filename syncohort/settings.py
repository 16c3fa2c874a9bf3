"""Study parameters, passed explicitly instead of read from globals."""

from __future__ import annotations

from dataclasses import dataclass

#: Columns that address one synthetic data set; every operator is keyed by them.
RUN = ("site", "model", "sim")

#: Code that stands for a missing stage in every metric.
MISSING_STAGE = 999


@dataclass(frozen=True)
class StudySettings:
    """Windows, codes and column roles of one study.

    The defaults are fixed values: they must equal the study being evaluated.
    """

    start_year: int = 2002
    end_year: int = 2021
    cutoff: str = "2021-12-31"
    year_group: int = 2
    max_age: int | None = None
    draws: int = 50
    runs: int = 50
    holdout_share: float = 0.2
    max_follow_up: float = 21.0
    winsor_percent: int = 5
    sequence: tuple[str, ...] = ("age", "sex", "stage", "daar_grp")
    numeric: tuple[str, ...] = ("exit_delta", "age", "sex", "t", "daar", "status")
    categorical: tuple[str, ...] = ("stage",)
    identifiers: tuple[str, ...] = ("daar", "age", "status", "exit_delta", "sex", "t")
    sensitive: str = "stage"
    stages: tuple[int, ...] = (1, 2, 3, MISSING_STAGE)
    fpr_levels: tuple[float, ...] = (0.0, 0.001, 0.01)


#: Model codes and names, fixed values used in every report.
MODEL_LABELS = {
    0: "Indep. marginals",
    1: "Model 1",
    2: "Model 2",
    3: "Model 3",
    4: "Model 4",
    5: "Model 5",
    6: "Resampling",
}

#: Sex and stage codes and names, fixed values.
SEX_LABELS = {0: "Females", 1: "Males"}
STAGE_LABELS = {
    0: "Total",
    1: "Localised",
    2: "Regional",
    3: "Distant",
    4: "I",
    5: "II",
    6: "III",
    7: "IV",
    8: "Unknown",
    9: "Non-malignant",
    10: "Malignant",
    99: "Total",
}
