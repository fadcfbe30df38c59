"""All queries of the library and the SQL that gives the same rows."""

from trailspark.plans import approaches, fields, files, intervals, kinematics, queueing, report, roads, scene, shapes, truth, world
from trailspark.plans.trk import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "approaches", "fields", "files", "intervals", "kinematics", "queueing", "report", "roads", "scene", "shapes", "truth", "world"]
