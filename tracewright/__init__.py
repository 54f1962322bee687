"""Spark-native analytics over microservice logs, code artifacts and service graphs."""
