"""brindle: a PySpark-native engine for ranked stories, discussion threads and the texts made from them."""
