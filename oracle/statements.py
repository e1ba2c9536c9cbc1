"""All SQL twins."""

from oracle import disclosure, feedback, intraday, modelling, screening, voice

SQL: dict[str, str] = {}
for part in (screening, modelling, disclosure, feedback, intraday, voice):
    SQL.update(part.SQL)
