"""Transaction-risk and customer-profile analytics on Spark.

Every operator is a function from DataFrame to DataFrame with its parameters and
its clock (``now``, ``as_of``) given explicitly.
"""
