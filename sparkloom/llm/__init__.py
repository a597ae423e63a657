"""Training-data operators.

Nothing outside this folder imports it; ``__spark_entry__`` registers
``sparkloom.llm.queries`` when it can be imported.
"""
