"""Quality of dimensional measurements on images, as Spark DataFrame operators."""
