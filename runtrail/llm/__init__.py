"""Operations of a training-data pipeline: ten operators over documents, pages, benchmark items and conversations.

Each operator module holds a general function over DataFrames; ``queries.py`` registers one thin query per operator.
"""
