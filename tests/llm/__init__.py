"""Tests of the text-preparation operators."""
