"""Operations for preparing language-model training data at corpus scale.

Nothing outside this package imports it.  Each operator module has a general
interface (DataFrame in, DataFrame out); ``queries`` derives the registered
queries from them.
"""
