"""Registered queries over the test tables, with independent SQL for each where SQL can say it."""
