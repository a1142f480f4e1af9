"""kedge: linking names in text to the entities of a knowledge base, as Spark plans.

Every operator takes and returns DataFrames; nothing in the data path is collected to the driver.
"""
