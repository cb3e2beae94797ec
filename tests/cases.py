"""Rows that several tests share."""

USERS = [(1, "Alice", 30, "Paris", 45000), (2, "Bruno", 25, "Lyon", 38000), (3, "Charlie", 17, "Paris", 12000), (4, "Dalia", 41, "Marseille", 72000), (5, "Eve", 28, "Lyon", 51000), (6, "Farid", 35, "Paris", 64000), (7, "Grace", 52, "Marseille", 80000), (8, "Hugo", 20, "Lyon", 29000), (9, "Iris", 33, "Paris", 47000), (10, "Jack", 16, "Marseille", 9000)]
USER_COLUMNS = [("id", "INTEGER"), ("nom", "STRING"), ("age", "INTEGER"), ("ville", "STRING"), ("salaire", "INTEGER")]
