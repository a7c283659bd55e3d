"""termlab: futures term-structure analytics as Spark DataFrame transformations.

Every operator is a function from DataFrame to DataFrame.  ``keys`` names the
columns that identify one curve (``[]`` means a single curve), and the column
names of each table grain are fixed in :mod:`termlab.schema`.
"""
