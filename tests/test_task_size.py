"""What one task holds does not grow with the tables: buckets of the order
tables grow in number."""

from repurchase.sources import bucket_count


def test_buckets_grow_in_number_not_in_size():
    sizes = [100 << 20, 1 << 30, 6 << 30, 30 << 30]
    assert all(n / bucket_count(n) <= 16 << 20 for n in sizes)
