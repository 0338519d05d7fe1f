"""Point-in-time analytics for sports and event data, written as Spark jobs.

Every feature of a row may depend only on facts known strictly before that row's time. The package
is organised by kind of work:

* ``sources``    tolerant readers, normalizers, append-only ledgers and published tables
* ``functions``  column expressions (odds arithmetic, normal distribution, labels, name keys)
* ``operators``  DataFrame to DataFrame operators (history, form, ratings, ridge, market, ...)
* ``plans``      whole jobs built from the operators, and the catalog of registered queries
* ``streaming``  Structured Streaming versions of the quote operators
"""
