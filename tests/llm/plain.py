"""Helpers of the brute-force versions."""

import string


def ascii_lower(text):
    return (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
