"""Skill-gap analytics over job postings, as Spark DataFrame plans."""
