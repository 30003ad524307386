"""Operators over tables of uncertain objects.

An instance table has query_id, object_id, instance_id, p, part and a0..an-1; against
query points (query_id, q0..qn-1) it gets distances d0..dn-1.
"""
