"""Names of the columns that carry a stratified, clustered, weighted design."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SurveyDesign:
    """Weight, strata and cluster columns.

    Stratum and cluster codes usually repeat between regions, so ``strata`` lists
    every column of the stratum key and ``psu`` only completes it.
    """

    weight: str
    strata: tuple[str, ...]
    psu: tuple[str, ...]

    @property
    def cluster(self) -> list[str]:
        return [*self.strata, *self.psu]
