"""corrob: event corroboration on Spark.

Turns tables and streams of text reports into verified, ranked events.  Every
operator is ``DataFrame -> DataFrame`` (or ``Column -> Column``) and takes an
explicit ``as_of`` time; nothing reads the wall clock or a global session.
"""
