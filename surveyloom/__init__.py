"""Complex-survey and observational analytics as Spark DataFrame operators."""

from surveyloom.design import SurveyDesign

__all__ = ["SurveyDesign"]
