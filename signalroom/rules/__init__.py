"""Fixed tables: code points, phrases, finding rules, magic numbers."""
