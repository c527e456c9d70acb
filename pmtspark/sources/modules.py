"""Schemas of the survey modules (one table per questionnaire section)."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()

MODULES: dict[str, T.StructType] = {
    "gsec1": _schema(HHID=_S, region=_I, urban=_I, month=_I, mult=_D),
    "gsec2": _schema(HHID=_S, PID=_S, h2q3=_I, h2q4=_I, h2q8=_I, h2q10=_I),
    "gsec4": _schema(HHID=_S, PID=_S, h4q5=_I, h4q7=_I, h4q9=_I),
    "gsec8": _schema(HHID=_S, PID=_S, **{f"h8q{i}": _I for i in range(4, 16)}),
    "gsec9a": _schema(HHID=_S, h9q3=_I, h9q4=_I, h9q5=_I, h9q6=_I, h9q7=_I, h9q22=_I),
    "gsec10a": _schema(HHID=_S, h10q1=_I, h10q12=_I),
    "gsec10b": _schema(HHID=_S, h10q8_1=_I, h10q8_2=_I),
    "gsec14": _schema(HHID=_S, h14q2=_I, h14q3=_I),
    "consumption": _schema(HHID=_S, cpexp30=_D, welfare=_D, poor=_I),
}
