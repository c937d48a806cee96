"""weekpanel: region x week panels from event counts and daily station readings, on Spark.

Every operator is a ``DataFrame -> DataFrame`` function (chain them with
``DataFrame.transform``) or a ``Column -> Column`` expression builder.  No
operator runs a hidden Spark action unless its docstring says so; the few that
do (table-level date-format choice, checked broadcasts, row positions) run one
small bounded aggregate and say why.
"""

__version__ = "0.1.0"
