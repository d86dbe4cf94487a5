"""Error models and priors by name, with the two facts jobs need to know about each.

A model of one's own is one more ``ErrorModel``: any function from columns to a
log-likelihood column (built-in functions first, a pandas UDF where they do not reach).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from tablemend.functions import loglik


@dataclass(frozen=True)
class ErrorModel:
    """``observes_missing``: a missing cell is evidence under this model, not merely a gap.
    ``enumerable``: its values can be listed as a domain with log-priors."""

    name: str
    loglik: Callable[..., Column]
    observes_missing: bool = False
    enumerable: bool = False

    def score(self, df: DataFrame, *args, out: str = "loglik", **options) -> DataFrame:
        return df.withColumn(out, self.loglik(*args, **options))


TYPOS = ErrorModel("typos", loglik.typos, observes_missing=True)
SWAP = ErrorModel("swap", loglik.swap, observes_missing=True)
FULL_NAME = ErrorModel("full_name", loglik.full_name, observes_missing=True)
ONE_NAME = ErrorModel("one_name", loglik.one_name, observes_missing=True)
ABBREVIATION = ErrorModel("abbreviation", loglik.abbreviation, observes_missing=True)
UNMODELLED = ErrorModel("unmodelled", loglik.unmodelled, observes_missing=True)
NOISE = ErrorModel("noise", loglik.gaussian)
UNIT_NOISE = ErrorModel("unit_noise", loglik.gaussian_in_unit)
NUMBER_CODE = ErrorModel("number_code", loglik.number_code)
# Text priors are scored against a letter table, by ``operators.domains.text_prior``.
UNIFORM = ErrorModel("uniform", loglik.uniform_choice, enumerable=True)
PROPORTIONAL = ErrorModel("proportional", loglik.proportional_choice, enumerable=True)
TIME = ErrorModel("time", loglik.time_of_day, enumerable=True)
